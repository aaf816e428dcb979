"""Readers and writers for the corpus's outer formats; Parquet inside."""
