"""The same flows over Structured Streaming."""
