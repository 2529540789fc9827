"""corpuslens: corpus profiling and per-corpus method selection on Spark DataFrames."""
