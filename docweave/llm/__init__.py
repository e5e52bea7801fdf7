"""Operators of a training-data pipeline: deduplication, decontamination,
language identification, quality filtering, tokenisation, archives and licence
scans. Nothing outside this folder imports it; ``registry`` holds the queries."""
