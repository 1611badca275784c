"""Whole plans: ingest and ask."""
