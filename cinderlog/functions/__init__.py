"""Log investigation on Spark: functions."""
