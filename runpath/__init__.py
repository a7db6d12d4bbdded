"""Program-flow analytics on Spark DataFrames."""
