"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import work_dir

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Later steps start from committed files, so a lost executor does not repeat
    what led to them, and the planner knows the size.
    """
    target = work_dir(df.sparkSession, label)
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower case for A to Z only."""
    return F.translate(text, UPPER, LOWER)


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def as_row(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """The given columns (all by default) as one struct, safe from clashing names."""
    return F.struct(*[F.col(quote(c)) for c in (df.columns if columns is None else columns)])


def id_key(column: Column) -> Column:
    """A grouping key for an identifier that keeps null apart from every value."""
    return F.coalesce(column.cast("string"), F.lit("~"))


def text_tag(name: str = "text") -> Column:
    """Tells rows of one id apart by their text."""
    return F.xxhash64(text_of(name))


def keep_rows(docs: DataFrame, stays: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` whose (id, text tag) is in ``stays`` (``id``, ``tag``), with all their columns.

    Of rows that repeat an id and a text one stays. Such rows are combined before
    the shuffle, and rows that share an id key meet only their own kind.
    """
    marked = docs.select(as_row(docs).alias("row"), id_key(F.col(quote(id_col))).alias("id"), text_tag(text_col).alias("tag"))
    once = marked.groupBy("id", "tag").agg(F.first("row").alias("row"))
    return once.join(stays.select(id_key(F.col("id")).alias("id"), "tag"), ["id", "tag"], "left_semi").select("row.*")


def scrambled(values: np.ndarray) -> np.ndarray:
    """A one-to-one mixing of 64-bit values, so that close inputs give unrelated outputs."""
    x = values.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
