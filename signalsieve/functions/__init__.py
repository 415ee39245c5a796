"""Column functions: no joins, no shuffles, JVM-side expressions only."""
