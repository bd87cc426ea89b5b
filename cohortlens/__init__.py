"""Screening-evaluation analytics as Spark DataFrame operators."""
