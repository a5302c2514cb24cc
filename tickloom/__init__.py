"""Market time-series and opinion analytics as Spark DataFrame operators."""
