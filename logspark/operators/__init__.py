"""DataFrame operators: every function takes DataFrames and returns a lazy DataFrame."""
