"""Operators of the feed engine."""
