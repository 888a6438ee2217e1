"""Column functions: comparisons of the dialect, aggregates."""
