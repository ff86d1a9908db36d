"""Postal address resolution as Spark DataFrame transformations."""
