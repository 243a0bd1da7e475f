"""Operators for preparing text and embeddings at corpus scale.

Every module holds one operator: a general function over DataFrames, and the
thin ``opN_<name>`` query that applies it to its whole table.  ``registry``
lists the queries.
"""
