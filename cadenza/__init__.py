"""Motion and signal analytics, written as Spark DataFrame operators."""
