"""Page-layout analytics on Spark: word boxes, spatial joins, reading order, source connectors."""

__version__ = "0.1.0"
