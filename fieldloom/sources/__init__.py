"""Readers and writers of raster, vector and report formats."""
