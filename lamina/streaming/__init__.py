"""Streams of mutations."""
