"""lexloom: lexical search, lookup and dictionary data processing on Spark."""

__version__ = "0.1.0"
