"""Operators for preparing training text: deduplication, filtering, mixing, packing and archives.

Nothing else in the library imports this subpackage.
"""
