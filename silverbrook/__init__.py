"""Multi-tenant Bronze / Silver / Gold data toolkit built from Spark DataFrames."""

__version__ = "0.1.0"
