"""Ordered computations over long series without one task per key.

A plain ``Window.partitionBy(key)`` puts the whole history of a key in one task.
Here a series is cut along a time cell, so a key that holds a large share of
all rows is spread over many tasks, with results equal to the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.session import steering

BLOCK = "_block"
OWN = "_own"
ROWS_PER_BLOCK = 200_000


def _joined(df: DataFrame, keys: list[str], cell: Column, steer: DataFrame) -> DataFrame:
    """``df`` with the columns of ``steer`` for its key and cell; NULL keys and NULL cells find their own."""
    named = steer.withColumnsRenamed({**{k: f"_k{i}" for i, k in enumerate(keys)}, "_cell": "_kc"})
    match = cell.eqNullSafe(F.col("_kc"))
    for i, k in enumerate(keys):
        match = match & df[k].eqNullSafe(F.col(f"_k{i}"))
    return df.join(named, match).drop("_kc", *[f"_k{i}" for i in range(len(keys))])


def _ends(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with the number of rows up to their end; NULL times come first, as in a window."""
    so_far = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    return cells.withColumn("_end", F.sum("_rows").over(so_far))


def cut_series(df: DataFrame, keys: list[str], cell: Column, lookback: int,
               rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Split each key's series into blocks that also carry the rows just before them.

    ``cell`` is a coarse time value that grows with the series order, such as
    its day. Rows are counted per cell; whole cells are packed into blocks of
    about ``rows_per_block`` rows, and cells that hold any of the ``lookback``
    rows before a later block are copied to that block with ``_own`` false.
    A window over ``keys + [_block]`` that looks back at most ``lookback`` rows is
    then exact on the ``_own`` rows.

    Rows with a NULL key or time stay, as they do in a plain window. The window
    over cells is bounded by the time span of the data, not by its rows. The
    counts are taken when this is called; the rows are then shuffled once, by key
    and block.
    """
    placed = _ends(df.groupBy(*keys, cell.alias("_cell")).agg(F.count("*").alias("_rows")), keys).select(
        *keys, "_cell",
        F.floor((F.col("_end") - F.col("_rows")) / rows_per_block).alias("_home"),
        F.floor((F.col("_end") + (lookback - 1)) / rows_per_block).alias("_last"),
    )
    copies = placed.select(
        *keys, "_cell", "_home",
        F.explode(F.sequence("_home", F.greatest("_home", "_last"))).alias(BLOCK))
    real = F.max(F.col("_home") == F.col(BLOCK)).over(W.partitionBy(*keys, BLOCK))
    copies = copies.withColumn("_real", real).filter("_real").select(
        *keys, "_cell", BLOCK, (F.col("_home") == F.col(BLOCK)).alias(OWN))
    return _joined(df, keys, cell, steering(copies, "cells"))


def block_series(df: DataFrame, keys: list[str], cell: Column, rows_per_block: int = ROWS_PER_BLOCK,
                 carried: dict[str, Column] | None = None, order: list[str] | None = None) -> DataFrame:
    """Number the blocks as :func:`cut_series` does, without copies.

    ``carried`` adds, per name, the last value that is not NULL in the cells
    before the row's own, with rows inside a cell in ``order``.
    """
    last = [F.max_by(value, F.when(value.isNotNull(), F.struct(*order))).alias(f"_v_{name}")
            for name, value in (carried or {}).items()]
    cells = df.groupBy(*keys, cell.alias("_cell")).agg(F.count("*").alias("_rows"), *last)
    earlier = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    steer = _ends(cells, keys).select(
        *keys, "_cell", F.floor((F.col("_end") - F.col("_rows")) / rows_per_block).alias(BLOCK),
        *[F.last(f"_v_{name}", True).over(earlier).alias(name) for name in carried or {}])
    return _joined(df, keys, cell, steering(steer, "cells"))


def block_window(keys: list[str], order: list[str]):
    return W.partitionBy(*keys, BLOCK).orderBy(*order)


def keep_own(df: DataFrame) -> DataFrame:
    return df.filter(OWN).drop(BLOCK, OWN)


def running_totals(df: DataFrame, keys: list[str], order: list[str], cell: Column,
                   totals: dict[str, Column]) -> DataFrame:
    """Add running sums per key: sums of earlier cells plus a window inside the cell."""
    sums = [F.coalesce(F.sum(value), F.lit(0)).alias(f"_t_{name}") for name, value in totals.items()]
    cells = df.groupBy(*keys, cell.alias("_cell")).agg(*sums)
    earlier = W.partitionBy(*keys).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    before = cells.select(*keys, "_cell", *[
        F.coalesce(F.sum(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_b_{name}") for name in totals])
    inside = W.partitionBy(*keys, "_cell").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    joined = _joined(df.withColumn("_cell", cell), keys, F.col("_cell"), steering(before, "cells"))
    return joined.select(*df.columns, *[
        (F.col(f"_b_{name}") + F.coalesce(F.sum(value).over(inside), F.lit(0))).alias(name)
        for name, value in totals.items()])
