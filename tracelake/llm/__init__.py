"""Training-data preparation operators (text, embeddings, web archives) on Spark DataFrames."""
