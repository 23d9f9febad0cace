"""Images as relations: a raster analytics engine on PySpark."""
