"""glyphmill: text analytics and full-text search expressed as Spark DataFrames."""

__version__ = "0.1.0"
