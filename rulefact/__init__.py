"""Provenance-aware rule reasoning over fact tables, on Spark DataFrames."""
