"""Tag-selected histogram analytics on Spark."""
