"""Extractors: one file in, many records out."""
