"""Retail energy plan analytics on Spark."""
