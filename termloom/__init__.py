"""Dictionaries of terms as Spark DataFrames: lookup, set algebra, logs, structure."""
