"""Whole results: report, Markdown, the catalogue of queries."""
