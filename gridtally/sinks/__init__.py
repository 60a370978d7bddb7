"""Parquet, CSV and JSON sinks."""
