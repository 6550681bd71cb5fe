"""Tidemark: market-disclosure analytics as Spark DataFrames."""
