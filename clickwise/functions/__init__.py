"""Column-expression builders (all Spark built-ins, no UDFs)."""
