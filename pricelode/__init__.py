"""Retail price analytics as PySpark DataFrame operators."""
