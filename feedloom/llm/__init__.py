"""Operators for preparing training text: deduplication, scans, token counts and encodings."""
