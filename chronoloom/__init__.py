"""Timeline analytics expressed as lazy PySpark DataFrame transformations."""
