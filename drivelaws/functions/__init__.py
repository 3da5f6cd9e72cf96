"""Column functions: scalars, the normal law, the six usage laws."""
