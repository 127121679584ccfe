"""Sales analytics as plain Spark DataFrame transformations."""
