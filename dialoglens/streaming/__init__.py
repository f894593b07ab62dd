"""Incremental versions with Structured Streaming."""
