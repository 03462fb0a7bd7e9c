"""Tabular data quality and reconciliation on Spark."""
