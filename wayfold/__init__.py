"""Spatio-temporal analytics expressed as Spark DataFrame plans."""
