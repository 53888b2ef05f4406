"""Readers and writers."""

from chronolith.sources.files import copy_series, export, ingest_csv, ingest_jsonl, ingest_vectors, merged_tiers, read_days, read_table, synthetic_bars, write_by_day, write_tiers

__all__ = ["copy_series", "export", "ingest_csv", "ingest_jsonl", "ingest_vectors", "merged_tiers", "read_days", "read_table", "synthetic_bars", "write_by_day", "write_tiers"]
