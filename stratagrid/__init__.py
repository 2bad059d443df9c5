"""Spark-first analytics for gridded range scans and the surfaces built from them."""
