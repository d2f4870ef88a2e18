"""Cohortia: a PySpark library for grouped recordings and their window-level vectors."""

__version__ = "0.1.0"
