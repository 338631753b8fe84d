"""Moving averages, crossover signals, RSI and MACD over bar series."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.errors import DataValidationError
from barloom.operators import series
from barloom.operators.series import BLOCK, ROWS_PER_BLOCK
from barloom.session import steering

SERIES_TYPES = ("open", "high", "low", "close")
MAX_LIMIT = 5000
# Powers of the decay stay within exp(+-600), inside the double range.
_SPAN = 600.0


def _cell(time: str, span: str) -> Column:
    """Calendar cell of a bar. A day of one-second bars is at most 86,400 rows."""
    day = F.to_date(time)
    return day if span == "day" else F.trunc(day, span)


def _price(series_type: str) -> str:
    if series_type not in SERIES_TYPES:
        raise DataValidationError(f"series_type must be one of {SERIES_TYPES}, not {series_type!r}")
    return series_type


def sma(bars: DataFrame, window: int, series_type: str = "close", out: str = "sma", key: str = "ticker",
        time: str = "window_start_et", rows_per_block: int = ROWS_PER_BLOCK, cell: str = "day") -> DataFrame:
    """Mean of the last ``window`` bars; NULL until there are that many."""
    cut = series.cut_series(bars, [key], _cell(time, cell), window, rows_per_block)
    return series.keep_own(_add_mean(cut, [key], [time], _price(series_type), window, out))


def _add_mean(cut: DataFrame, keys: list[str], order: list[str], price: str, window: int,
              out: str) -> DataFrame:
    """Mean of the last ``window`` rows where all have a price, by sums of whole and part pieces.

    Rows are cut into pieces of ``window`` rows. The last ``window`` rows of a row
    are the end of the piece before and the beginning of its own: a running sum
    from either side, added. Nothing is subtracted, so NaN, infinity and outliers
    leave with their row, whatever the length.
    """
    w = series.block_window(keys, order)
    placed = cut.withColumn("_at", F.row_number().over(w) - 1).withColumn("_piece", F.floor(F.col("_at") / window))
    piece = W.partitionBy(*keys, BLOCK, "_piece")
    head = piece.orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    # What follows the row in its piece; NULL at the piece's end.
    tail = piece.orderBy(F.desc("_at")).rowsBetween(W.unboundedPreceding, -1)
    summed = placed.withColumns({
        "_head": F.sum(price).over(head), "_heads": F.count(price).over(head),
        "_tail": F.sum(price).over(tail), "_tails": F.count(price).over(tail)})
    before = W.partitionBy(*keys, BLOCK).orderBy("_at")
    total = F.coalesce(F.lag("_tail", window).over(before), F.lit(0.0)) + F.col("_head")
    count = F.coalesce(F.lag("_tails", window).over(before), F.lit(0)) + F.col("_heads")
    return summed.withColumn(out, F.when(count == window, total / window)).drop("_at", "_piece", "_head", "_heads", "_tail", "_tails")


def sma_cross(bars: DataFrame, fast: int = 10, slow: int = 40, series_type: str = "close",
              key: str = "ticker", time: str = "window_start_et",
              rows_per_block: int = ROWS_PER_BLOCK, cell: str = "day") -> DataFrame:
    """Bars where the fast average crosses the slow one: signal 1 upwards, -1 downwards.

    Upwards means fast below slow on the bar before and above it now; both
    averages must be defined on both bars.
    """
    price = _price(series_type)
    cut = series.cut_series(bars, [key], _cell(time, cell), max(fast, slow) + 1, rows_per_block)
    cut = _add_mean(cut, [key], [time], price, fast, "fast_sma")
    cut = _add_mean(cut, [key], [time], price, slow, "slow_sma")
    gap = F.col("fast_sma") - F.col("slow_sma")
    before = F.lag(gap).over(series.block_window([key], [time]))
    signal = F.when((before < 0) & (gap > 0), 1).when((before > 0) & (gap < 0), -1)
    return series.keep_own(cut.withColumn("signal", signal)).filter(F.col("signal").isNotNull())


def _smoothed(df: DataFrame, keys: list[str], order: list[str], averages: list[tuple[str, str, float]],
              of_gap: tuple[str, float] | None = None) -> DataFrame:
    """Add ``out = alpha * x + (1 - alpha) * previous out`` per ``(x, out, alpha)``, for a frame with blocks.

    Only values that are not NULL count: the first is the seed, and a NULL keeps
    the last average. All ``x`` are NULL on the same rows. Over a piece of values
    the recursion maps the average before it to the one after it: what it decays
    to, plus what the piece adds by itself. The latter is a running sum of
    ``x / decay^i`` times ``decay^i``. The few pieces of a key are chained, and each
    row adds what its piece's beginning decays to. No history is cut off.

    ``of_gap`` (out, alpha) adds the average of the first average less the second.
    It is linear in the same state: over ``k`` values a beginning that decays by
    ``a`` adds ``alpha * a * (g^k - a^k) / (g - a)`` of itself to an average that
    decays by ``g``. So it needs no pass of its own. Its seed is 0, since both
    averages begin with the first value.
    """
    n = range(len(averages))
    rates = [math.inf if alpha >= 1 else -math.log1p(-alpha) for _, _, alpha in averages]
    if of_gap:
        rates.append(math.inf if of_gap[1] >= 1 else -math.log1p(-of_gap[1]))
    every = range(len(rates))
    step = max(1, int(_SPAN / max([r for r in rates if r < math.inf], default=1.0)))
    w = series.block_window(keys, order)
    running = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = df.withColumn("_at", F.row_number().over(w)).withColumn("_rank", F.count(averages[0][0]).over(running)).withColumn(
        "_piece", F.expr(f"(greatest(_rank, 1) - 1) div {step}")).withColumn("_offset", F.col("_rank") - F.col("_piece") * step)
    inside = W.partitionBy(*keys, BLOCK, "_piece").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)

    def decay(rate: float, offset: Column) -> Column:
        return F.when(offset == 0, 1.0).otherwise(0.0) if rate == math.inf else F.exp(offset * -rate)

    added = {}
    for i, ((x, _, alpha), rate) in enumerate(zip(averages, rates)):
        value = F.last(x, True).over(inside) if rate == math.inf else \
            F.sum(F.col(x) * F.exp(F.col("_offset") * rate)).over(inside) * alpha * F.exp(F.col("_offset") * -rate)
        added[f"_own{i}"] = F.coalesce(value, F.lit(0.0))
    pieces = ranked.withColumns(added)
    if of_gap:
        gap = F.col("_own0") - F.col("_own1")
        counted = F.when(F.col(averages[0][0]).isNotNull(), gap)
        total = gap if rates[-1] == math.inf else \
            F.sum(counted * F.exp(F.col("_offset") * rates[-1])).over(inside) * of_gap[1] * F.exp(F.col("_offset") * -rates[-1])
        pieces = pieces.withColumn(f"_own{len(averages)}", F.coalesce(total, F.lit(0.0)))

    def carried(i: int, offset: Column) -> Column:
        """What one unit of the average ``i`` at a piece's beginning adds to the average of the gap."""
        g, a = (math.exp(-rates[k]) for k in (-1, i))
        if g == a:
            return of_gap[1] * offset * decay(rates[-1], offset)
        return (decay(rates[-1], offset) - decay(rates[i], offset)) * (of_gap[1] * a / (g - a))

    def moved(start: list[Column], offset: Column, own: list[Column]) -> list[Column]:
        """The averages so many values behind a beginning."""
        out = [start[i] * decay(rates[i], offset) + own[i] for i in every]
        if of_gap:
            out[-1] = out[-1] + start[0] * carried(0, offset) - start[1] * carried(1, offset)
        return out

    summed = pieces.groupBy(*keys, BLOCK, "_piece").agg(
        F.max("_offset").alias("_count"), *[F.max_by(f"_own{i}", "_at").alias(f"_own{i}") for i in every],
        *[F.min_by(x, F.when(F.col(x).isNotNull(), F.col("_at"))).alias(f"_first{i}") for i, (x, _, _) in enumerate(averages)])
    listed = summed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        BLOCK, "_piece", "_count", *[f"_own{i}" for i in every], *[f"_first{i}" for i in n]))).alias("_pieces"))
    double = F.lit(None).cast("double")

    def chain(state: Column, p: Column) -> Column:
        start = [F.coalesce(state[f"s{i}"], p[f"_first{i}"] if i in n else F.lit(0.0)) for i in every]
        after = moved(start, p["_count"], [p[f"_own{i}"] for i in every])
        end = [F.when(p["_count"] == 0, state[f"s{i}"]).otherwise(after[i]) for i in every]
        before = F.struct(p[BLOCK].alias("_b"), p["_piece"].alias("_p"), state["s0"].isNotNull().alias("_known"),
                          *[start[i].alias(f"_start{i}") for i in every])
        return F.struct(*[e.alias(f"s{i}") for i, e in enumerate(end)], F.concat(state["out"], F.array(before)).alias("out"))

    kind = "array<struct<_b:bigint,_p:bigint,_known:boolean," + ",".join(f"_start{i}:double" for i in every) + ">>"
    chained = listed.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.inline(F.aggregate(
        "_pieces", F.struct(*[double.alias(f"s{i}") for i in every], F.array().cast(kind).alias("out")), chain)["out"]))
    match = (F.col(BLOCK) == F.col("_b")) & (F.col("_piece") == F.col("_p"))
    for i, k in enumerate(keys):
        match = match & pieces[k].eqNullSafe(F.col(f"_k{i}"))
    joined = pieces.join(steering(chained, "pieces"), match)
    known = F.col("_known") | (F.col("_rank") > 0)
    values = moved([F.col(f"_start{i}") for i in every], F.col("_offset"), [F.col(f"_own{i}") for i in every])
    names = [out for _, out, _ in averages] + ([of_gap[0]] if of_gap else [])
    return joined.select(*df.columns, *[F.when(known, value).alias(out) for value, out in zip(values, names)])


def ema(bars: DataFrame, window: int, series_type: str = "close", out: str = "ema", key: str = "ticker",
        time: str = "window_start_et", rows_per_block: int = ROWS_PER_BLOCK, cell: str = "day") -> DataFrame:
    """Exponential average with ``alpha = 2 / (window + 1)``, seeded with the first price; NULL prices keep it."""
    cut = series.block_series(bars, [key], _cell(time, cell), rows_per_block)
    return _smoothed(cut, [key], [time], [(_price(series_type), out, 2.0 / (window + 1))]).drop(BLOCK)


def rsi(bars: DataFrame, window: int = 14, series_type: str = "close", out: str = "rsi",
        key: str = "ticker", time: str = "window_start_et",
        rows_per_block: int = ROWS_PER_BLOCK, cell: str = "day") -> DataFrame:
    """Relative strength index with Wilder smoothing, ``alpha = 1 / window``.

    NULL up to the first price; 100 when the smoothed loss is zero. A change is
    taken from the last price that is not NULL; a NULL price keeps the index.
    """
    alpha = 1.0 / window
    price = _price(series_type)
    cut = series.block_series(bars, [key], _cell(time, cell), rows_per_block, {"_earlier": F.col(price)}, [time])
    before = series.block_window([key], [time]).rowsBetween(W.unboundedPreceding, -1)
    change = F.col(price) - F.coalesce(F.last(price, True).over(before), F.col("_earlier"))
    cut = cut.withColumn("_change", change)
    cut = cut.withColumn("_gain", F.greatest("_change", F.lit(0.0) * F.col("_change")))
    cut = cut.withColumn("_loss", F.greatest(-F.col("_change"), F.lit(0.0) * F.col("_change")))
    smooth = _smoothed(cut, [key], [time], [("_gain", "_up_avg", alpha), ("_loss", "_down_avg", alpha)])
    strength = F.try_divide(F.col("_up_avg"), F.col("_down_avg"))
    index = F.when(F.col("_down_avg") == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + strength))
    return smooth.withColumn(out, F.when(F.col("_down_avg").isNotNull(), index)).drop(
        BLOCK, "_earlier", "_change", "_gain", "_loss", "_up_avg", "_down_avg")


def macd(bars: DataFrame, short: int = 12, long: int = 26, signal: int = 9, series_type: str = "close",
         key: str = "ticker", time: str = "window_start_et",
         rows_per_block: int = ROWS_PER_BLOCK, cell: str = "day") -> DataFrame:
    """``macd`` (short EMA minus long EMA), its EMA ``signal``, and their ``histogram``; NULL prices keep all three."""
    if short >= long:
        raise DataValidationError("the short window must be below the long window")
    price = _price(series_type)
    alphas = [2.0 / (n + 1) for n in (short, long, signal)]
    cut = series.block_series(bars, [key], _cell(time, cell), rows_per_block)
    cut = _smoothed(cut, [key], [time], [(price, "_short", alphas[0]), (price, "_long", alphas[1])], ("signal", alphas[2]))
    cut = cut.withColumn("macd", F.col("_short") - F.col("_long"))
    cut = cut.withColumn("histogram", F.col("macd") - F.col("signal"))
    return cut.select(*[c for c in cut.columns if c not in (BLOCK, "_short", "_long", "macd", "signal", "histogram")], "macd", "signal", "histogram")


def latest_values(indicator: DataFrame, limit: int = 10, order: str = "desc",
                  time: str = "window_start_et", key: str = "ticker") -> DataFrame:
    """The first ``limit`` rows of an indicator result in time order."""
    if not 0 < limit <= MAX_LIMIT:
        raise DataValidationError(f"limit must be 1..{MAX_LIMIT}")
    by = F.col(time).desc() if order == "desc" else F.col(time).asc()
    return indicator.orderBy(by, key).limit(limit)


def running_day_vwap(bars: DataFrame, price: str = "close", key: str = "ticker",
                     time: str = "window_start_et") -> DataFrame:
    """Add the day's volume and VWAP so far (``accumulated_volume``, ``aggregate_vwap``).

    A ticker has one bar per minute (or second), so its day bounds the window.
    """
    w = W.partitionBy(key, "trade_date").orderBy(time).rowsBetween(W.unboundedPreceding, W.currentRow)
    volume = F.sum("volume").over(w)
    return bars.withColumn("trade_date", F.to_date(time)).withColumns({
        "accumulated_volume": volume,
        "aggregate_vwap": F.try_divide(F.sum(F.col(price) * F.col("volume")).over(w), volume.cast("double")),
    })


def running_day_vwap_of_trades(trades: DataFrame, key: str = "ticker", time: str = "ts_et",
                               sequence: str = "sequence") -> DataFrame:
    """The same per trade. Trades of a ticker and day are unbounded, so they are summed by hour first."""
    out = series.running_totals(
        trades.withColumn("trade_date", F.to_date(time)), [key, "trade_date"], [time, sequence], F.hour(time),
        {"accumulated_volume": F.col("size"), "_value": F.col("price") * F.col("size")})
    return out.withColumn(
        "aggregate_vwap", F.try_divide(F.col("_value"), F.col("accumulated_volume").cast("double"))
    ).drop("_value")
