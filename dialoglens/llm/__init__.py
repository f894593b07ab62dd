"""Operators for preparing training text: quality, toxicity, deduplication, mixing, counting and packing.

Nothing else in the library imports this subpackage.
"""
