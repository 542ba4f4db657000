"""metrikon: retrieval evaluation and corpus operators as lazy Spark plans."""

__version__ = "0.1.0"
