"""Operators of the catalogue library."""
