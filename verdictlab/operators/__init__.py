"""Operators of verdictlab."""
