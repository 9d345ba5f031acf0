"""lattiq: dense numerical analytics on Spark DataFrames."""
