"""Streaming of the document analytics engine."""
