"""Point-cloud region analytics on Spark DataFrames."""
