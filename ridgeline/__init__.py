"""Memory-bounded learning on Spark DataFrames."""
