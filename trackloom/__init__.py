"""Track, identity and event analytics as Spark DataFrame operators."""
