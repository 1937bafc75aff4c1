"""Earthquake-catalogue analytics on PySpark."""
