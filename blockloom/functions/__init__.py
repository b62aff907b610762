"""Column functions: expressions in, expression out."""
