"""Compositional count-table analytics on Spark."""
