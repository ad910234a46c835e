"""Build, refresh and question a retrieval corpus with Spark DataFrames."""

__version__ = "0.1.0"
