"""Customer-value analytics on Spark."""
