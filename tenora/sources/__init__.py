"""Readers and writers: Parquet tables, snapshots, request logs and streams."""
