"""Audio/text training pairs from listening reports and chunk catalogs, on Spark."""

__version__ = "0.1.0"
