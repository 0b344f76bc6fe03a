"""Training-data operators: language, duplicates, mixing, scoring, retrieval, tokens.

Nothing else in the library imports this subpackage.
"""
