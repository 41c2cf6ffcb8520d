"""Operators for training-data pipelines.

Nothing else in the library imports this subpackage.  Each operator has a
module with its general interface; ``queries.py`` holds the thin ``opN_<name>``
queries and their SQL.
"""
