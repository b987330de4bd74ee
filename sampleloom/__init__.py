"""Sample pipelines on Spark: lazy DataFrames of array-valued columns in an explicit row order."""

__version__ = "0.1.0"
