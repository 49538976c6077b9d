"""Structured Streaming over trace folders."""
