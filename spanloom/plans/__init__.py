"""Composed queries and step plans."""
