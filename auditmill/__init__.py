"""Code-audit analytics as Spark DataFrame operators."""
