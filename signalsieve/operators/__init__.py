"""DataFrame operators. Each takes DataFrames and returns a lazily planned DataFrame."""
