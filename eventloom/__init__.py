"""Event-log analytics on Spark: trackers are declared in a small text language
and compiled to DataFrame column expressions."""

__version__ = "0.1.0"
