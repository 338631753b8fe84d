"""Structured Streaming jobs over landed event messages and stored bars."""
