"""Germline sequencing analytics as PySpark DataFrame transformations."""
