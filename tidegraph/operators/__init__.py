"""Operators on versioned tables; each takes and returns DataFrames."""
