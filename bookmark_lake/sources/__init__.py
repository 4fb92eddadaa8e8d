"""Captured responses and the service parsers that turn them into fragments and requests."""
