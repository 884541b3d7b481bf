"""Scans of text and columnar inputs into the canonical long tables."""
