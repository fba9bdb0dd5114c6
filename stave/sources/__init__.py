"""Readers and parsers for the catalogue's input formats."""
