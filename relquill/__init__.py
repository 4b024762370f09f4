"""A SQL engine surface on Spark DataFrames."""
