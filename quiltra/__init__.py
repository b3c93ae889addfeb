"""Time-frequency grid analytics as Spark DataFrame operators."""
