"""Parsers from source text to fact rows."""
