"""Readers, writers and the tables they keep."""
