"""Sources of verdictlab."""
