"""Streaming wrappers."""
