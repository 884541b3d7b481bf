"""Set-evidence operators; every function takes and returns DataFrames."""
