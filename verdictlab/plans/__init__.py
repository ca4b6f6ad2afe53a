"""Plans of verdictlab."""
