"""Document retrieval, grounding and corpus preparation on Spark DataFrames."""
