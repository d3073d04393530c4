"""Operators of a training-data pipeline over a ``documents`` table.

Nothing outside this folder imports it.  Each module holds one operator with a
general interface; ``queries`` holds the thin registered queries.
"""
