"""clausemill: text analytics and retrieval on Spark DataFrames."""
