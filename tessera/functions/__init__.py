"""Columns from text."""
