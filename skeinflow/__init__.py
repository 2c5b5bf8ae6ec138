"""skeinflow: keyed tables, bag and pair collections, and web-search analytics as lazy Spark plans."""

__version__ = "0.1.0"
