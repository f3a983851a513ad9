"""Log investigation on Spark: plans."""
