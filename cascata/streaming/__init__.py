"""Change-logs: incremental maintenance with Structured Streaming."""
