"""Validation, comparison, staging rules, profiling."""
