"""Operators for preparing language-model training data at scale.

Every operator takes DataFrames and returns a DataFrame.  Nothing outside this
subpackage imports it; its registered queries are in :mod:`graphloom.llm.queries`.
"""
