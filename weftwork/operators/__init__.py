"""Parsing jobs over log records."""
