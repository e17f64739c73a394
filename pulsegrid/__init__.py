"""Event-time features, labels and risk reports on PySpark DataFrames."""

__version__ = "0.1.0"
