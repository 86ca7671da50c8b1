"""runlumen: job-run observability on Spark DataFrames, Spark SQL and Structured Streaming."""
