"""Declarative data requests compiled to lazy Spark DataFrames."""
