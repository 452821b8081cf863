"""Prospect analytics on Spark: ingest, page signals, scoring, pipeline reports and their streams."""
