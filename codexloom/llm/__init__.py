"""Operators for large training-text corpora; each takes and returns DataFrames."""
