"""Readers of flat files, the bar store and landed reference data."""
