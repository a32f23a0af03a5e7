"""Column functions: every text step is a Catalyst expression."""
