"""Table operators: each function takes DataFrames and explicit parameters and returns DataFrames."""
