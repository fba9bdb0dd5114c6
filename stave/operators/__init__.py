"""Operators over catalogue tables keyed by track."""
