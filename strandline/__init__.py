"""strandline: ordered-series and data-quality operators on PySpark."""

__version__ = "0.1.0"
