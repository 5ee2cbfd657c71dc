"""Operators for preparing large text corpora and embedding tables.

Nothing outside this subpackage imports it; ``registry`` lists its queries.
"""
