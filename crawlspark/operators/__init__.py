"""Queries over crawls, pages and links as DataFrame transformations."""
