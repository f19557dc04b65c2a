"""Structured Streaming counterparts of the cache logs."""
