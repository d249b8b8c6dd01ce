"""Operators for preparing training text: packing, search, dedup, extraction, archives, filters.

Nothing outside this subpackage imports it.
"""
