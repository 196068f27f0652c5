"""Column functions: time arithmetic and names."""
