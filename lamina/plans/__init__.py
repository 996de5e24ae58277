"""Commit log, tables and compaction."""
