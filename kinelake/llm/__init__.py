"""Operators for preparing large text corpora, with the queries that apply them.

Nothing outside this subpackage imports it.
"""
