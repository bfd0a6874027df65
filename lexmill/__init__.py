"""lexmill: a text-retrieval and ranking-evaluation engine on PySpark DataFrames."""

__version__ = "0.1.0"
