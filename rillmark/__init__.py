"""Flood and debris impact analytics as Spark DataFrame plans."""
