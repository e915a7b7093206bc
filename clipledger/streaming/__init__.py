"""Structured Streaming form of the watched folder."""
