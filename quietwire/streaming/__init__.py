"""Structured Streaming forms of the profiles and the routing join."""
