"""Document-to-speech data preparation on Spark DataFrames."""
