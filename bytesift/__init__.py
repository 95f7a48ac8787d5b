"""bytesift: screening of large document collections against byte-pattern rules, on Spark."""

__version__ = "0.1.0"
