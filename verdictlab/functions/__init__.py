"""Functions of verdictlab."""
