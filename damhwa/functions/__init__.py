"""Column functions and the rule pack."""
