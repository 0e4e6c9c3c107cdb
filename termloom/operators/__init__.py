"""Lookup, set algebra, mutation, substrings, vocabularies, logs and structure of dictionaries."""
