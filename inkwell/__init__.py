"""inkwell: headline analytics as PySpark DataFrame operators."""
