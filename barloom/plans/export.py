"""Exports of reference data."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom import schemas
from barloom.plans.barquery import parse_day


def due_splits(splits: DataFrame, as_of=None) -> DataFrame:
    """Splits executed up to ``as_of`` (today if not given), oldest first."""
    day = parse_day(as_of) if as_of is not None else date.today()
    return splits.filter(F.col("execution_date") <= F.lit(day)).select(
        *schemas.SPLIT_EXPORT_COLUMNS).orderBy("execution_date", "ticker", "id")


def export_splits(splits: DataFrame, folder: str, as_of=None) -> str:
    """Write due splits as CSV with a header to ``split_data_<as_of>`` and return that path.

    Files follow the date order of the rows; the number of files follows the data
    size. An empty result still gets a file with the header.
    """
    day = parse_day(as_of) if as_of is not None else date.today()
    target = f"{folder.rstrip('/')}/split_data_{day.isoformat()}"
    out = due_splits(splits, day)
    if out.isEmpty():
        out = out.coalesce(1)
    out.write.mode("overwrite").option("header", True).csv(target)
    return target
