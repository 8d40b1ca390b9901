"""Operators for preparing language-model training data, each on Spark DataFrames.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; ``queries`` wraps them as registered
queries over the standard tables.
"""
