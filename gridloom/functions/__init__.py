"""functions of the raster and tile engine."""
