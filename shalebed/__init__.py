"""Shalebed: evidence analytics as Spark DataFrame operators."""
