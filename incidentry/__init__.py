"""Incident analytics as PySpark DataFrame operators."""
