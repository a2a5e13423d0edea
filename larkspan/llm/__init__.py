"""Operators over text and media corpora. Nothing outside this package imports it."""
