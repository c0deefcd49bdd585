"""geolathe: command-style pipelines over attribute tables and vector geometry, on Spark."""

__version__ = "0.1.0"
