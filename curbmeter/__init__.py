"""Trip-record analytics as Spark DataFrame operators."""
