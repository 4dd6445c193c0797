"""Operators over DataFrames of the corpus model."""
