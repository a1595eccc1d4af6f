"""DataFrame operators: each takes and returns DataFrames and runs no job by itself."""
