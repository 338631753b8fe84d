"""Operators over bars, ticks and reference data."""
