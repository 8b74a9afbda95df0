"""Operators of a training-data pipeline over text documents and vectors.

Nothing else in the library imports this subpackage. Every operator is a
function of DataFrames; ``queries`` registers one query per operator.
"""
