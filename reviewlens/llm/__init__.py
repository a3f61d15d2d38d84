"""Operators for training-data pipelines on Spark DataFrames of documents, vectors and benchmark items."""
