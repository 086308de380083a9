"""Text-similarity sketching and corpus preparation over Spark DataFrames."""

__version__ = "0.1.0"
