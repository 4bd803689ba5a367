"""Query registry (key -> Spark DataFrame job) and DuckDB oracle SQL."""
