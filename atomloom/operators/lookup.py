"""Fact lookup: ground goals against stored statements, exactly, then by canonical arguments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from atomloom.functions import symbols as S
from atomloom.operators import atoms as A


def canonical_key(body):
    """Head and canonical arguments of a flat atom as one string; null for anything else."""
    a = A.simple_atom(body)
    return F.when(a.isNotNull(), F.concat_ws(" ", a["head"], a["arity"].cast("string"), F.array_join(F.transform(a["args"], lambda x: S.canonical(x)), " ")))


def first_by(statements: DataFrame, key: str) -> DataFrame:
    """(key, raw): of the statements with one key the first, by file, then by place."""
    return statements.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("file_rank", "seq", "raw")).alias("m")).select(key, F.col("m.raw").alias("raw"))


def looked_up(goals: DataFrame, statements: DataFrame) -> DataFrame:
    """(goal_no, tier string, raw): goals that a stored statement answers.

    goals is (goal_no, goal), statements (file_rank, seq, raw). A goal with a variable in it, or not of the form of a
    goal, is never answered. Equal bodies in any file come before equal canonical forms in any file; among equals the
    first file and place count. The strength of a statement doesn't matter. Statements are reduced to one for each
    body before the join, so hot bodies are cheap.
    """
    asked = goals.select("goal_no", A.ground_goal(F.col("goal")).alias("body")).where("body is not null")
    stored = statements.withColumn("body", A.statement_body(F.col("raw")))
    exact = asked.join(first_by(stored, "body"), "body", "left")
    hit = exact.where("raw is not null").select("goal_no", F.lit("exact").alias("tier"), "raw")
    missed = exact.where("raw is null").select("goal_no", canonical_key(F.col("body")).alias("key"))
    close = missed.join(first_by(stored.withColumn("key", canonical_key(F.col("body"))), "key"), "key").select("goal_no", F.lit("canonical").alias("tier"), "raw")
    return hit.unionByName(close)
