"""Readers and writers: Parquet tables, JSON documents, listings."""
