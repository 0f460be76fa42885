"""Operators for preparing large text corpora: quality, secrets, joins, mixing, tokens, search."""
