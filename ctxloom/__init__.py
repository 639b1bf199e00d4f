"""Context assembly and analytics on Spark DataFrames."""
