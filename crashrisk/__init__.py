"""Road-incident analytics as Spark DataFrame operators."""
