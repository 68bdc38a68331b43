"""binweave: linked-histogram analytics on Spark DataFrames."""
