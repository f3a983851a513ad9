"""Log investigation on Spark: operators."""
