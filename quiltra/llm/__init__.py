"""Operators for preparing language-model training text, all on Spark DataFrames.

Nothing outside this subpackage imports it.
"""
