"""Tidemark: windowed global aggregation over partitioned event streams, on PySpark."""
