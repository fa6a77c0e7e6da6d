"""Commerce and marketing analytics as Spark DataFrame, SQL and streaming jobs."""
