"""Cut series equal plain windows, whatever the block size and however hot a key is."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.errors import DataValidationError
from barloom.operators import indicators, series, stats


@pytest.fixture(scope="module")
def bars(spark):
    """One key with most rows, one short key, a key with a single row, and a crowded day."""
    rng = np.random.default_rng(5)
    rows = []
    for ticker, days, per_day in (("HOT", 40, 60), ("COLD", 12, 5), ("ONE", 1, 1)):
        for d in range(days):
            n = per_day * 20 if (ticker, d) == ("HOT", 17) else per_day
            for i in range(n):
                rows.append((ticker, d * 86400 + i * 30, float(rng.integers(100, 200)) / 4, int(rng.integers(0, 9))))
    return spark.createDataFrame(rows, "ticker STRING, s BIGINT, close DOUBLE, volume BIGINT").select(
        "ticker", F.timestamp_add("SECOND", F.col("s"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias(
            "window_start_et"), "close", "volume").cache()


def as_pandas(df):
    return df.toPandas().sort_values(["ticker", "window_start_et"]).reset_index(drop=True)


def per_ticker(bars, fn):
    frame = as_pandas(bars)
    return pd.concat([fn(g["close"]) for _, g in frame.groupby("ticker", sort=True)]).reset_index(drop=True)


def same(left, right):
    np.testing.assert_allclose(left.astype(float), right.astype(float), rtol=1e-9, atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("block, lookback", [(1, 1), (7, 3), (50, 10), (100, 250), (100_000, 40)])
def test_every_row_has_one_home_and_its_lookback(bars, block, lookback):
    cut = series.cut_series(bars, ["ticker"], F.to_date("window_start_et"), lookback, block)
    assert cut.filter("_own").count() == bars.count()
    w = W.partitionBy("ticker").orderBy("window_start_et").rowsBetween(-lookback, W.currentRow)
    plain = bars.withColumn("m", F.sum("close").over(w)).withColumn("n", F.count("close").over(w))
    b = series.block_window(["ticker"], ["window_start_et"]).rowsBetween(-lookback, W.currentRow)
    blocked = series.keep_own(cut.withColumn("m", F.sum("close").over(b)).withColumn("n", F.count("close").over(b)))
    left, right = as_pandas(plain), as_pandas(blocked.select(plain.columns))
    assert (left["n"] == right["n"]).all()
    same(left["m"], right["m"])


def test_blocks_stay_near_their_size(bars):
    cut = series.cut_series(bars, ["ticker"], F.to_date("window_start_et"), 10, 200)
    sizes = cut.groupBy("ticker", "_block").count().agg(F.max("count")).first()[0]
    # A block holds its own rows, one cell of lookback, and at most one crowded cell.
    assert sizes < 200 + 60 * 20 + 60


@pytest.mark.parametrize("window", [5, 200])
@pytest.mark.parametrize("block", [64, 100_000])
def test_sma(bars, window, block):
    found = as_pandas(indicators.sma(bars, window, rows_per_block=block, cell="day" if block < 1000 else "month"))
    same(found["sma"], per_ticker(bars, lambda s: s.rolling(window).mean()))


@pytest.mark.parametrize("window", [1, 2, 9, 50, 1000])
@pytest.mark.parametrize("block", [100, 100_000])
def test_ema(bars, window, block):
    found = as_pandas(indicators.ema(bars, window, rows_per_block=block, cell="day" if block < 1000 else "month"))
    same(found["ema"], per_ticker(bars, lambda s: s.ewm(span=window, adjust=False).mean()))


def pandas_rsi(s, n):
    change = s.diff()
    gain = change.clip(lower=0).iloc[1:].ewm(alpha=1 / n, adjust=False).mean()
    loss = (-change.clip(upper=0)).iloc[1:].ewm(alpha=1 / n, adjust=False).mean()
    value = (100 - 100 / (1 + gain / loss)).where(loss != 0, 100.0)
    return value.reindex(s.index)


@pytest.mark.parametrize("block", [100, 100_000])
def test_rsi(bars, block):
    found = as_pandas(indicators.rsi(bars, 14, rows_per_block=block, cell="day" if block < 1000 else "month"))
    same(found["rsi"], per_ticker(bars, lambda s: pandas_rsi(s, 14)))


@pytest.mark.parametrize("spans", [(12, 26, 9), (2, 300, 3)])
@pytest.mark.parametrize("block", [100, 100_000])
def test_macd(bars, spans, block):
    short, long, signal = spans

    def expected(s):
        m = s.ewm(span=short, adjust=False).mean() - s.ewm(span=long, adjust=False).mean()
        return pd.DataFrame({"macd": m, "signal": m.ewm(span=signal, adjust=False).mean()})

    found = as_pandas(indicators.macd(bars, short, long, signal, rows_per_block=block, cell="day" if block < 1000 else "month"))
    want = per_ticker(bars, expected)
    same(found["macd"], want["macd"])
    same(found["signal"], want["signal"])
    same(found["histogram"], want["macd"] - want["signal"])


@pytest.mark.parametrize("block", [100, 100_000])
def test_crossovers(bars, block):
    def expected(s):
        gap = s.rolling(10).mean() - s.rolling(40).mean()
        up = (gap.shift() < 0) & (gap > 0)
        down = (gap.shift() > 0) & (gap < 0)
        return up.astype(int) - down.astype(int)

    found = indicators.sma_cross(bars, rows_per_block=block, cell="day" if block < 1000 else "month")
    assert found.count() == int((per_ticker(bars, expected) != 0).sum())
    assert found.agg(F.sum("signal")).first()[0] == int(per_ticker(bars, expected).sum())


def test_running_totals_equal_a_plain_window(bars):
    trades = bars.withColumnsRenamed({"close": "price", "volume": "size"}).withColumn("sequence", F.lit(0))
    found = as_pandas(indicators.running_day_vwap_of_trades(trades, time="window_start_et"))
    w = W.partitionBy("ticker", F.to_date("window_start_et")).orderBy("window_start_et").rowsBetween(
        W.unboundedPreceding, W.currentRow)
    plain = as_pandas(bars.withColumn("v", F.sum("volume").over(w)).withColumn(
        "p", F.try_divide(F.sum(F.col("close") * F.col("volume")).over(w), F.sum("volume").over(w))))
    assert (found["accumulated_volume"] == plain["v"]).all()
    same(found["aggregate_vwap"], plain["p"])


@pytest.mark.parametrize("probs", [{"q": 0.5}, {"a": 0.0, "b": 0.25, "c": 0.999, "d": 1.0}])
def test_exact_quantiles(bars, probs):
    found = stats.exact_quantiles(bars, "ticker", "close", probs).toPandas().set_index("ticker")
    frame = as_pandas(bars)
    for name, p in probs.items():
        want = frame.groupby("ticker")["close"].quantile(p)
        same(found[name].sort_index(), want.sort_index())


def test_quantiles_of_far_apart_values(spark):
    rows = [("A", float(v)) for v in list(range(1000)) + [1e15]] + [("B", 7.0)] * 50 + [("C", -3.5), ("C", None)]
    frame = spark.createDataFrame(rows, "ticker STRING, close DOUBLE")
    found = {r.ticker: r.q for r in stats.exact_quantiles(frame, "ticker", "close", {"q": 0.75}).collect()}
    assert found == {"A": 750.0, "B": 7.0, "C": -3.5}


def test_undefined_statistics_are_null(spark):
    rows = [("A", 1.0, 5), ("A", 1.0, 9), ("B", 2.0, 1)]
    frame = spark.createDataFrame(rows, "ticker STRING, close DOUBLE, volume BIGINT").withColumn(
        "low", F.col("close")).withColumn("high", F.col("close"))
    found = {r.ticker: r for r in stats.ticker_statistics(frame).collect()}
    assert found["A"].price_volume_correlation is None and found["A"].price_volatility == 0
    assert found["B"].price_volatility is None and found["B"].median_price == 2.0


def test_argument_errors(bars):
    with pytest.raises(DataValidationError):
        indicators.sma(bars, 3, "volume")
    with pytest.raises(DataValidationError):
        indicators.macd(bars, 26, 12)
    with pytest.raises(DataValidationError):
        indicators.latest_values(bars, 0)


def gaps(spark):
    """NULL, NaN and huge prices, NULL times and a NULL ticker."""
    rng = np.random.default_rng(11)
    rows = []
    for ticker in ("A", "B", None):
        for i in range(600):
            price = float(rng.integers(100, 200)) / 4
            price = None if i < 3 or i % 7 == 2 or 200 <= i < 330 else price
            rows.append((ticker, i * 3600, price))
    rows += [("A", None, 7.0), ("B", None, None)]
    return spark.createDataFrame(rows, "ticker STRING, s BIGINT, close DOUBLE").select(
        "ticker", F.timestamp_add("SECOND", F.col("s"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("window_start_et"), "close")


def by_key(df, *columns):
    """Rows per ticker in window order: NULL times first."""
    found = {}
    for r in df.collect():
        found.setdefault(r.ticker, []).append(r)
    return {k: [tuple(r[c] for c in columns) for r in sorted(v, key=lambda r: (r.window_start_et is not None, r.window_start_et or 0))]
            for k, v in found.items()}


@pytest.mark.parametrize("block", [50, 100_000])
def test_smoothing_skips_nulls_and_keeps_every_row(spark, block):
    bars = gaps(spark)
    for name, got in (("ema", by_key(indicators.ema(bars, 9, rows_per_block=block), "close", "ema")),
                      ("macd", by_key(indicators.macd(bars, 3, 8, 4, rows_per_block=block), "close", "macd", "signal"))):
        assert sum(map(len, got.values())) == 1802
        for rows in got.values():
            s = pd.Series([r[0] for r in rows], dtype=float)
            real = s.dropna()
            if name == "ema":
                want = pd.DataFrame({"ema": real.ewm(span=9, adjust=False).mean()})
            else:
                m = real.ewm(span=3, adjust=False).mean() - real.ewm(span=8, adjust=False).mean()
                want = pd.DataFrame({"macd": m, "signal": m.ewm(span=4, adjust=False).mean()})
            want = want.reindex(s.index).ffill()
            for k, column in enumerate(want.columns, 1):
                same(pd.Series([r[k] for r in rows], dtype=float), want[column])


@pytest.mark.parametrize("block", [50, 100_000])
def test_rsi_skips_nulls(spark, block):
    for rows in by_key(indicators.rsi(gaps(spark), 5, rows_per_block=block), "close", "rsi").values():
        s = pd.Series([r[0] for r in rows], dtype=float)
        same(pd.Series([r[1] for r in rows], dtype=float), pandas_rsi(s.dropna(), 5).reindex(s.index).ffill())


def test_prices_after_a_gap(spark):
    rows = [(i, p) for i, p in enumerate([None, None, 10.0, 10.0, None, None, None, 10.0])]
    bars = spark.createDataFrame(rows, "i INT, close DOUBLE").select(
        F.lit("X").alias("ticker"), F.timestamp_add("HOUR", F.col("i"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("window_start_et"), "close")
    assert [r[0] for r in by_key(indicators.ema(bars, 3), "ema")["X"]] == [None, None] + [pytest.approx(10.0)] * 6


@pytest.mark.parametrize("window", [127, 128, 129, 500])
def test_outliers_leave_the_mean_with_their_row(spark, window):
    values = [math.nan, 1e17, math.inf] + [1.0] * 1200
    values[700] = None
    bars = spark.createDataFrame(list(enumerate(values)), "i INT, close DOUBLE").select(
        F.lit("X").alias("ticker"), F.timestamp_add("MINUTE", F.col("i"), F.expr("timestamp_ntz'2024-01-01 00:00:00'")).alias("window_start_et"), "close")
    for block in (100, 100_000):
        got = [r[0] for r in by_key(indicators.sma(bars, window, rows_per_block=block), "sma")["X"]]
        clean = [i for i in range(window + 2, len(values)) if not i - window < 700 <= i]
        assert all(got[i] == 1.0 for i in clean)
        assert got[:window - 1] == [None] * (window - 1) and math.isnan(got[window - 1])
        assert all(got[i] is None for i in range(700, min(700 + window, len(values))))


def test_running_totals_keep_rows_without_key_or_time(spark):
    trades = spark.createDataFrame([("A", None, 1, 2.0), (None, "2024-01-01 10:00:00", 3, 4.0), ("A", "2024-01-01 10:00:00", 5, 6.0)],
                                   "ticker STRING, t STRING, size BIGINT, price DOUBLE").selectExpr(
        "ticker", "CAST(t AS TIMESTAMP_NTZ) AS ts_et", "size", "price", "0 AS sequence")
    assert sorted(r.accumulated_volume for r in indicators.running_day_vwap_of_trades(trades).collect()) == [1, 3, 5]


@pytest.mark.parametrize("made", [
    lambda bars: indicators.sma(bars, 20), lambda bars: indicators.ema(bars, 20),
    lambda bars: indicators.rsi(bars, 14), lambda bars: indicators.macd(bars),
    lambda bars: indicators.sma_cross(bars),
    lambda bars: stats.exact_quantiles(bars, "ticker", "close", {"q": 0.5}),
])
def test_no_window_runs_over_all_rows_of_a_key(bars, made):
    plan = made(bars)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if line.lstrip(" :+-").startswith("Window ["):
            # By block or cell, or over counts and sums per cell.
            assert any(part in line for part in ("_block", "_cell", "_rows")), line
