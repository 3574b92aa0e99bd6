"""Operators for preparing training text: encoding, scans, deduplication, filters, shards.

Nothing else in the library imports this package.
"""
