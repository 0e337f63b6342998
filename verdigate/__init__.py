"""Decision-audit analytics as plain Spark DataFrame transformations."""

__version__ = "0.1.0"
