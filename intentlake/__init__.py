"""Intent search and corpus processing as Spark DataFrames."""
