"""Readers (JSONL / JSON / text / parquet) and the derived QA inputs."""
