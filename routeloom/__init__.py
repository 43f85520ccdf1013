"""Route and contract analytics on PySpark: relational kernels, source extraction, incremental state."""
