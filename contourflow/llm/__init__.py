"""Operators for preparing text corpora: scoring, search, tokenizing, cleaning and deduplication.

Nothing outside this package imports it.
"""
