"""Structured Streaming jobs over the live gauge feed."""
