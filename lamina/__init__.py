"""Keyed, mutable data on immutable files, as DataFrame plans."""
