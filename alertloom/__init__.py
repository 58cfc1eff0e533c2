"""Security-alert analytics expressed as Spark DataFrame operators."""
