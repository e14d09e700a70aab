"""Whole flows: tables from logs, and stand-in logs from other tables."""
