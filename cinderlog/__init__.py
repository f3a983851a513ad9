"""Log investigation as DataFrame operators on Spark."""
