"""Query and table operators: each takes and returns DataFrames."""
