"""Document retrieval on Spark: which documents hold a pattern, how often, and in what order."""
