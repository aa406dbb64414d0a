"""Part of the raster-suitability engine."""
