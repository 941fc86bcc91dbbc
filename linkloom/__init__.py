"""Share-link analytics on Spark DataFrames."""
