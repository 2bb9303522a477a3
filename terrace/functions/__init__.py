"""Column expressions: numbers, quantiles and geometry."""
