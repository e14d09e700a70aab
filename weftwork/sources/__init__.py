"""Readers and writers of exported history."""
