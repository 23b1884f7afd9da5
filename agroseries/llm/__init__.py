"""Operators for preparing training text, each a function from tables to a table.

``queries`` holds the thin queries over the given tables, the other modules the operators. Nothing
outside this package imports it.
"""
