"""countloom: counted-set analytics on Spark DataFrames."""
