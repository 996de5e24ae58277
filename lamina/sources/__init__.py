"""Readers and writers of other formats, and generators."""
