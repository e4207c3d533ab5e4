"""Raster, terrain and point-inventory analytics as composable Spark DataFrame operators."""
