"""Operators for preparing training text: filters, scans, de-duplication, encoding.

Nothing outside this package imports it.
"""
