"""geoloom: region-level geospatial analytics expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
