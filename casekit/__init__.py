"""Case and ticket analytics as lazy PySpark DataFrame transformations."""
