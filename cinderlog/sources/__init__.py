"""Log investigation on Spark: sources."""
