"""Readers of series and writers of results."""
