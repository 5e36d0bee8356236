"""Column builders: every function takes columns (or names) and returns a column."""
