"""Operators over large text corpora: filters, joins, deduplication, scans and tokens."""
