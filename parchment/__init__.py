"""Parchment: provenance-preserving document analytics on PySpark DataFrames."""
