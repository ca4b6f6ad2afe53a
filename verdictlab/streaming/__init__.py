"""Streaming of verdictlab."""
