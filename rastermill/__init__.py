"""Spark-native raster suitability analytics, as DataFrame-to-DataFrame operators."""
