"""Structured Streaming forms of the observation operators (an extension)."""
