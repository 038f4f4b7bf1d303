"""Table-in / table-out jobs. Every function takes and returns DataFrames."""
