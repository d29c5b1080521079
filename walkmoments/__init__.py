"""Walk-moment analytics of large undirected graphs on Spark DataFrames."""
