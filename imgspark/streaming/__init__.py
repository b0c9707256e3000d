"""Structured Streaming twins of the progress queries."""
