"""girder: DataFrame operators for software-architecture analytics on Spark."""

__version__ = "0.1.0"
