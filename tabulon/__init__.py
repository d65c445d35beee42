"""Tabular document analytics on Spark."""
