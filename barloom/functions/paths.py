"""Expressions over file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def partition_value(path: Column, key: str) -> Column:
    """Value of the ``key=value`` folder in a path, unescaped; NULL if absent."""
    raw = F.regexp_extract(path, f"/{key}=([^/]+)/", 1)
    plain = F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B")))
    return F.when(raw != "", plain)


def partition_folder(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]+$", 1)


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def file_date(path: Column) -> Column:
    """Date of a file named ``YYYY-MM-DD...``; NULL for other names."""
    return F.try_to_date(F.regexp_extract(file_name(path), r"^(\d{4}-\d{2}-\d{2})", 1), "yyyy-MM-dd")
