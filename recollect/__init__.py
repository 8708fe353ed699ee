"""recollect: agent-memory analytics on Spark DataFrames."""
