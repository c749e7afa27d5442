"""Market-basket analytics on Spark."""
