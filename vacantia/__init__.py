"""vacantia: job-posting analytics as Spark DataFrame, SQL and Structured Streaming jobs."""
