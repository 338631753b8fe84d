"""Spark jobs and operators for market bars, ticks and their reference data."""

from barloom.plans.barquery import BarQuery
from barloom.session import build_session
from barloom.sources.barstore import BarStore

__all__ = ["BarQuery", "BarStore", "build_session"]
