"""Operators for building training data from large text corpora.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; ``queries`` binds them to the test tables.
"""
