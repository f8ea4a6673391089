"""Operators for preparing text and records for language models; nothing outside imports this package."""
