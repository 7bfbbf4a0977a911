"""Settings with typed defaults, from the environment or a file of KEY=VALUE lines; the environment wins."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    parser: str = "canonical"
    ingest_context: bool = True
    chunk_size: int = 512
    chunk_overlap: int = 64
    paragraph_chunk_size: int = 0
    context_top_k: int = 10
    batch_max_sentences: int = 4
    batch_max_chars: int = 2000
    query_fallback_enabled: bool = True
    chaining_timeout: float = 30.0
    chaining_max_steps: int = 100
    background_min_weight: float = 2.0
    background_coverage_percent: float = 100.0
    background_sample_seed: int = 42
    background_auto_rebuild: bool = True
    background_fail_open: bool = False
    kb_path: str = "kb/statements"
    vector_path: str = "kb/points"
    manifest_path: str = "kb/manifest.json"

    @staticmethod
    def load(env_file: str | None = None, prefix: str = "ATOMLOOM_") -> "Settings":
        """Unknown keys are ignored; a value that doesn't fit its type is an error that names the key."""
        found: dict[str, str] = {}
        if env_file and os.path.exists(env_file):
            for line in open(env_file, encoding="utf-8"):
                key, eq, value = line.partition("=")
                if eq and not line.lstrip().startswith("#"):
                    found[key.strip()] = value.strip().strip("\"'")
        found.update(os.environ)
        out = {}
        for f in fields(Settings):
            raw = found.get(prefix + f.name.upper())
            if raw is not None:
                kind = {"str": str, "int": int, "float": float, "bool": lambda x: x.strip().lower() in ("1", "true", "yes", "on")}[f.type]
                try:
                    out[f.name] = kind(raw)
                except ValueError as e:
                    raise ValueError(f"{prefix}{f.name.upper()}: {e}") from e
        return Settings(**out)
