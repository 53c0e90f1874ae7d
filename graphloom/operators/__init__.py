"""Graph operators as DataFrame algebra: traversal, writes, validation, diff, quality and taint analysis."""
