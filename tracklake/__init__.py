"""GPS-track and map-data analytics as PySpark DataFrame operators."""
