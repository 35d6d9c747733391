"""Event-study and tape analytics as Spark DataFrame operators."""
