"""tidescore: batch and stream model scoring on Spark DataFrames."""
