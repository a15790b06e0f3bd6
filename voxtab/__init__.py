"""Labelled 3-D scans as tables, and text corpora as tables, on PySpark."""
