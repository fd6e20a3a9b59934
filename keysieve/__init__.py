"""keysieve: leaked-credential analytics and redaction expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
