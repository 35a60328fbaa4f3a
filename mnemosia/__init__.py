"""Knowledge-graph memory engine on Spark DataFrames."""
