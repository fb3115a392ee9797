"""Comparison of protein sequences and structures, as Spark DataFrame operators."""
