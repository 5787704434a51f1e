"""Raster, vector and table analytics as Spark DataFrame operators."""
