"""quarrylens: PySpark tables, views and reports over rich JSON artifacts."""

__version__ = "0.1.0"
