"""Document retrieval and conversation analytics on Spark DataFrames."""
