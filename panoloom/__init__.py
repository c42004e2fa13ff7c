"""Frame-sequence analytics as PySpark DataFrame operators."""
