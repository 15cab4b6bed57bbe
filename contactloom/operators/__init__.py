"""Operators on contact maps, windows, links, datasets and reports."""
