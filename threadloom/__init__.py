"""Reply-graph analytics over Spark DataFrames."""
