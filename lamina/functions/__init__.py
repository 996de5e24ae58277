"""Scalar functions over keys, values and names."""
