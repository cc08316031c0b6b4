"""Structured document retrieval and corpus analytics on Spark DataFrames."""
