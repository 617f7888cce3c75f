"""Operators for preparing training data: scanning, scoring, tokenizing, deduplicating, extracting and packing text."""
