"""Operators of a training-data pipeline over document tables.

Nothing else in the package imports this subpackage. The queries of ``queries.py`` apply
each operator to its whole table.
"""
