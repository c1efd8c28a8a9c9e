"""Document-library analytics and corpus processing on Spark DataFrames."""
