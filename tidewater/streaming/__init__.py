"""Live queries over Structured Streaming, and the commit log."""
