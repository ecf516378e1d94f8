"""Log-stream analytics as PySpark DataFrame transformations."""
