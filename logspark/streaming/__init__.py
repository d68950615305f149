"""The log flow as Structured Streaming."""
