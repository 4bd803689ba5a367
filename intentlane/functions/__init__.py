"""Column-level helpers: built-in Spark expressions only (stay in codegen)."""
