"""Operators of a training-data pipeline over a table of documents.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and the names of its id and text columns, selects those columns first (so extra
columns of the input, whatever their names, can neither clash with nor change a
result) and returns a DataFrame.
"""
