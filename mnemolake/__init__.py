"""Conversational-memory analytics on PySpark."""
