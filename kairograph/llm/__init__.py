"""Operators for large training corpora: deduplication, filtering, extraction, scans and tokenising.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
