"""nearfield: similarity search and retrieval analytics over Spark DataFrames."""
