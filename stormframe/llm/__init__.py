"""Operators that prepare training data: deduplication, archives, scoring, selection and token files.

Nothing outside this subpackage imports it.
"""
