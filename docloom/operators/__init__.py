"""Operators of the document analytics engine."""
