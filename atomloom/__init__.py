"""Knowledge-base ingestion and logical question answering on Spark DataFrames."""
