"""Operators for preparing training text: scans, deduplication, search, tokens, packing.

Self-contained: nothing else in the library imports this subpackage.
"""
