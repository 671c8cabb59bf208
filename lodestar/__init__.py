"""Records analytics on Spark."""
