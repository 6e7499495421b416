"""Task-log analytics on Spark: DataFrame and Structured Streaming operators over work-queue tables."""
