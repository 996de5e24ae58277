"""Relational operators over mutations."""
