"""Log investigation on Spark: streaming."""
