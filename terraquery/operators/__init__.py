"""Physical-plan-aware operators; every function maps DataFrames to DataFrames."""
