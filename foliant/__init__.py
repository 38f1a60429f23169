"""foliant: analytics for digitised periodicals on PySpark DataFrames."""

__version__ = "0.1.0"
