"""Tallyard: Spark-first cleaning, matching and export of business-directory data."""

__version__ = "0.1.0"
