"""Lectern: reading analytics on Spark."""
