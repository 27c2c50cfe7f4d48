"""Text-trend analytics on Spark DataFrames."""
