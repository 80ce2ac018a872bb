"""Operators that prepare training data: deduplication, filters, mixing, encoding.

Nothing else in the library imports this subpackage.
"""
