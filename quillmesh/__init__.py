"""Paper-knowledge analytics expressed as PySpark DataFrame operators."""
