"""Day-over-day operators. Their windows run over daily rows, whose number per
ticker is bounded by the calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.errors import DataValidationError
from barloom.functions.ratios import change_percent


def with_previous_close(daily: DataFrame, key: str = "ticker", date: str = "trade_date") -> DataFrame:
    """Add the close of the ticker's previous row and the change against it."""
    before = F.lag("close").over(W.partitionBy(key).orderBy(date))
    return daily.withColumn("previous_close", before).withColumns({
        "change": F.col("close") - F.col("previous_close"),
        "change_percent": change_percent(F.col("close"), F.col("previous_close")),
    })


def session_change(sessions: DataFrame) -> DataFrame:
    """Change by session: early and regular against the previous close, late against today's close."""
    dated = with_previous_close(sessions)
    early, late = F.col("early_close"), F.col("after_hours")
    return dated.withColumns({
        "early_trading_change": early - F.col("previous_close"),
        "early_trading_change_percent": change_percent(early, F.col("previous_close")),
        "regular_trading_change": F.col("close") - F.col("previous_close"),
        "regular_trading_change_percent": change_percent(F.col("close"), F.col("previous_close")),
        "late_trading_change": late - F.col("close"),
        "late_trading_change_percent": change_percent(late, F.col("close")),
    })


def top_movers(daily: DataFrame, day, direction: str = "gainers", n: int = 20,
               include_otc: bool = False) -> DataFrame:
    """The ``n`` largest gains or losses in percent of one day against the previous close.

    ``daily`` has one row per ticker and day; cut the bars it is made of at the
    end of ``day`` so that later ones are not read.
    """
    if direction not in ("gainers", "losers"):
        raise DataValidationError(f"direction is gainers or losers, not {direction!r}")
    rows = daily.filter(F.col("trade_date") <= F.lit(day).cast("date"))
    if not include_otc and "otc" in rows.columns:
        rows = rows.filter(~F.coalesce(F.col("otc"), F.lit(False)))
    # The last close before the day combines before the shuffle; only rows of the day itself are kept whole.
    today = F.lit(day).cast("date")
    date = F.col("trade_date")
    rest = [c for c in rows.columns if c != "ticker"]
    picked = rows.groupBy("ticker").agg(
        F.max_by("close", F.when(date < today, date)).alias("previous_close"),
        F.max_by(F.struct(*rest), F.when(date == today, date)).alias("_today")).filter("_today IS NOT NULL")
    moved = picked.select("ticker", "_today.*", "previous_close").withColumns({
        "change": F.col("close") - F.col("previous_close"),
        "change_percent": change_percent(F.col("close"), F.col("previous_close")),
    }).filter("change_percent IS NOT NULL")
    by = F.col("change_percent").desc() if direction == "gainers" else F.col("change_percent").asc()
    return moved.orderBy(by, "ticker").limit(n)
