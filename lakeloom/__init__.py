"""lakeloom: a multi-model analytics engine on Spark DataFrames."""
