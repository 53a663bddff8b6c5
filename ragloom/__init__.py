"""ragloom: building and analysing evaluation sets for retrieval-augmented generation on Spark."""

__version__ = "0.1.0"
