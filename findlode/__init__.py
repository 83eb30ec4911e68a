"""A Spark engine for content similarity search and the analytics around it."""
