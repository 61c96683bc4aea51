"""Segmentation data at scale on PySpark: tiles, polygons, run-length masks and their metrics."""
