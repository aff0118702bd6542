"""Trade-abuse analytics as Spark DataFrame operators."""
