"""kilnwork: audit-data analytics as Spark DataFrame operators."""
