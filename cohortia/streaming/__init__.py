"""Streaming jobs over append-only logs and metric files."""
