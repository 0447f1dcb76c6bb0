"""Column helpers: every function returns a Column built from Spark built-ins."""
