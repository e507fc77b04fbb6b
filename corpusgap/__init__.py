"""Compare text corpora and predict quality drops between them, on Spark DataFrames."""

__version__ = "0.1.0"
