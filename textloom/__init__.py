"""Document analytics on Spark DataFrames: cleaning, splitting, tagging, merging, retrieval and training rows."""
