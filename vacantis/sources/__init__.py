"""Readers of landing tables and writers of results."""
