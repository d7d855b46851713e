"""Text-origin analytics on Spark: detection tables, features, neighbours, ensembles, metrics."""

__version__ = "0.1.0"
