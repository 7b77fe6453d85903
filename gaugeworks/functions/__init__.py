"""Column functions: the algebra of missing and broken values, and window aggregators."""
