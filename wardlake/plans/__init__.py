"""Whole flows: import, filter, export."""
