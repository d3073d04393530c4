"""Feed analytics on PySpark."""
