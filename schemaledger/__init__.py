"""History of database schemas across a large estate, on Spark DataFrames."""

__version__ = "0.1.0"
