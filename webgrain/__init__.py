"""webgrain: captured web pages and request logs as Spark DataFrames."""
