"""SQL of several dialects, and copy-on-write tables, on PySpark."""
