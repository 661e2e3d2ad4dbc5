"""strandline: temporal co-occurrence, retrieval and evidence analytics on Spark DataFrames."""
