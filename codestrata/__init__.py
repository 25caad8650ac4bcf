"""codestrata: analytics over bodies of source text, expressed as Spark DataFrames."""

__version__ = "0.1.0"
