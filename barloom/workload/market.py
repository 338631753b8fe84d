"""Analytics over trades and bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import clock
from barloom.operators import adjust, daily, indicators, rows, snapshot, stats
from barloom.operators import bars as barops
from barloom.plans.ingest import trading_hours_only
from barloom.workload import query
from barloom.workload.inputs import (
    BASE, TICKERS, bars, corr, day, moment, portable, quotes, r, ratio, sql, stored_bars, table, trades,
)

OHLC_SQL = f"{r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close"


@query("vwap_daily", sql(
    f"SELECT ticker, {day('CAST(window_start_et AS DATE)')} AS trade_date, "
    f"{r(ratio('sum(close * volume)', 'sum(volume)'))} AS vwap, count(*) AS data_points, "
    "CAST(sum(volume) AS BIGINT) AS total_volume, "
    f"{r('min(low)')} AS day_low, {r('max(high)')} AS day_high, "
    f"{r(ratio('(max(high) - min(low))', 'avg(close)'))} AS daily_range_pct "
    "FROM bars GROUP BY 1, 2 ORDER BY 1, 2", "bars"))
def vwap_daily(spark, sf_dir):
    return portable(stats.daily_vwap(bars(spark, sf_dir)).orderBy("ticker", "trade_date"))


@query("vwap_daily_wide", sql(
    f"SELECT ticker, {day('CAST(window_start_et AS DATE)')} AS trade_date, "
    f"{r(ratio('sum(close * volume)', 'sum(volume)'))} AS vwap, count(*) AS data_points, "
    "CAST(sum(volume) AS BIGINT) AS total_volume, "
    f"{r('min(low)')} AS day_low, {r('max(high)')} AS day_high, "
    f"{r(ratio('(max(high) - min(low))', 'avg(close)'))} AS daily_range_pct "
    "FROM wide_bars GROUP BY 1, 2", "wide_bars"))
def vwap_daily_wide(spark, sf_dir):
    return portable(stats.daily_vwap(bars(spark, sf_dir, wide=True)))


@query("minute_bars", sql(
    f"SELECT ticker, {moment('window_start_et')} AS window_start_et, {OHLC_SQL}, volume, transactions, "
    f"{r('vwap')} AS vwap FROM bars", "bars"))
def minute_bars(spark, sf_dir):
    return portable(bars(spark, sf_dir))


_STATS_SQL = (
    f"SELECT ticker, count(*) AS data_points, {r('avg(close)')} AS avg_price, "
    f"{r('stddev_samp(close)')} AS price_volatility, {r('avg(volume)')} AS avg_volume, "
    f"{r('min(low)')} AS min_price, {r('max(high)')} AS max_price, "
    f"{r('quantile_cont(close, 0.5)')} AS median_price, {r('quantile_cont(close, 0.25)')} AS q1_price, "
    f"{r('quantile_cont(close, 0.75)')} AS q3_price, {r(corr('close', 'volume'))} AS price_volume_correlation ")


@query("ticker_stats", sql(_STATS_SQL + "FROM bars GROUP BY ticker ORDER BY ticker", "bars"))
def ticker_stats(spark, sf_dir):
    return portable(stats.ticker_statistics(stored_bars(spark, sf_dir)).orderBy("ticker"))


@query("ticker_stats_wide", sql(_STATS_SQL + "FROM wide_bars GROUP BY ticker", "wide_bars"))
def ticker_stats_wide(spark, sf_dir):
    return portable(stats.ticker_statistics(stored_bars(spark, sf_dir, wide=True)))


@query("base_correlation", sql(
    f"SELECT d.ticker, {r(corr('b.daily_close', 'd.daily_close'))} AS correlation, count(*) AS data_points "
    f"FROM daily d JOIN (SELECT * FROM daily WHERE ticker = '{BASE}') b ON d.trade_date = b.trade_date "
    f"WHERE d.ticker <> '{BASE}' GROUP BY 1 ORDER BY 2 DESC", "daily"))
def base_correlation(spark, sf_dir):
    found = stats.base_correlation(stats.daily_closes(stored_bars(spark, sf_dir)), BASE)
    return portable(found.orderBy(F.desc_nulls_last("correlation")))


@query("daily_closes", sql(
    f"SELECT ticker, {day('trade_date')} AS trade_date, {r('daily_close')} AS daily_close FROM daily", "daily"))
def daily_closes(spark, sf_dir):
    return portable(stats.daily_closes(stored_bars(spark, sf_dir)))


@query("pivot_daily_close", sql(
    f"SELECT {day('trade_date')} AS trade_date, " + ", ".join(
        r(f"max(CASE WHEN ticker = '{t}' THEN daily_close END)") + f' AS "{t}"' for t in TICKERS)
    + " FROM daily GROUP BY trade_date", "daily"))
def pivot_daily_close(spark, sf_dir):
    return portable(stats.pivot_closes(stats.daily_closes(stored_bars(spark, sf_dir)), TICKERS))


_WIDE_PIVOT = ("SELECT trade_date, " + ", ".join(
    f'max(CASE WHEN ticker = \'{t}\' THEN daily_close END) AS "{t}"' for t in TICKERS)
    + " FROM daily GROUP BY trade_date")
_COMPLETE = " AND ".join(f'"{t}" IS NOT NULL' for t in TICKERS)


@query("pivot_correlation", sql(
    " UNION ALL ".join(
        f"SELECT '{t}' AS ticker, " + r(corr(f'"{BASE}"', f'"{t}"'))
        + f" AS correlation, count(*) FILTER (WHERE {_COMPLETE}) AS data_points FROM pivoted"
        for t in TICKERS if t != BASE), "daily", pivoted=_WIDE_PIVOT))
def pivot_correlation(spark, sf_dir):
    return portable(stats.pivot_correlation(stats.daily_closes(stored_bars(spark, sf_dir)), TICKERS, BASE))


@query("pair_correlation", sql(
    f"SELECT b.ticker AS base, d.ticker, {r(corr('b.daily_close', 'd.daily_close'))} AS correlation, "
    "count(*) AS data_points FROM daily d JOIN daily b ON d.trade_date = b.trade_date "
    f"AND d.ticker <> b.ticker AND b.ticker IN ('{BASE}', 'CLICK') GROUP BY 1, 2", "daily"))
def pair_correlation(spark, sf_dir):
    return portable(stats.pair_correlation(stats.daily_closes(stored_bars(spark, sf_dir)), [BASE, "CLICK"]))


@query("distinct_tickers", sql("SELECT count(DISTINCT ticker) AS tickers FROM wide_trades", "wide_trades"))
def distinct_tickers(spark, sf_dir):
    return portable(stats.ticker_count(trades(spark, sf_dir, wide=True)))


def _coarse_sql(bucket: str, source: str = "bars", vwap: bool = False, where: str = "") -> str:
    weighted = f", {r(ratio('sum(vwap * volume)', 'sum(volume)'))} AS vwap" if vwap else ""
    return (
        f"SELECT ticker, {moment(bucket)} AS bar_start, {r('arg_min(open, window_start_et)')} AS open, "
        f"{r('max(high)')} AS high, {r('min(low)')} AS low, {r('arg_max(close, window_start_et)')} AS close, "
        "CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(transactions) AS BIGINT) AS transactions"
        f"{weighted} FROM {source} {where} GROUP BY ticker, {bucket}")


_FIVE = "time_bucket(INTERVAL 5 MINUTE, window_start_et)"


@query("resample_5m", sql(_coarse_sql(_FIVE), "bars"))
def resample_5m(spark, sf_dir):
    return portable(barops.resample(stored_bars(spark, sf_dir)))


_FILLED = (
    "SELECT g.ticker, {moment} AS bar_start, c.open, c.high, c.low, c.close, "
    "coalesce(c.volume, 0) AS volume, coalesce(c.transactions, 0) AS transactions "
    "FROM grid g LEFT JOIN coarse c ON c.ticker = g.ticker AND c.bar_start = {moment} {where}"
).replace("{moment}", moment("g.slot"))
_GRID = (
    "SELECT ticker, unnest(generate_series(min(b), max(b), INTERVAL 5 MINUTE)) AS slot "
    f"FROM (SELECT ticker, {_FIVE} AS b FROM bars) GROUP BY ticker")


@query("resample_5m_filled", sql(
    _FILLED.replace("{where}", ""), "bars", coarse=_coarse_sql(_FIVE), grid=_GRID))
def resample_5m_filled(spark, sf_dir):
    return portable(barops.resample(stored_bars(spark, sf_dir), fill_gaps=True))


@query("resample_5m_session", sql(
    _FILLED.replace("{where}", "WHERE hour(g.slot) * 60 + minute(g.slot) BETWEEN 570 AND 959 "
                               "AND isodow(g.slot) <= 5"),
    "bars", coarse=_coarse_sql(_FIVE), grid=_GRID))
def resample_5m_session(spark, sf_dir):
    return portable(barops.resample(stored_bars(spark, sf_dir), fill_gaps=True, session_only=True))


@query("bars_15m", sql(_coarse_sql("time_bucket(INTERVAL 15 MINUTE, window_start_et)", vwap=True), "bars"))
def bars_15m(spark, sf_dir):
    return portable(barops.aggregate_bars(stored_bars(spark, sf_dir), 15, "minute"))


@query("bars_4h", sql(_coarse_sql(
    "time_bucket(INTERVAL 4 HOUR, window_start_et, TIMESTAMP '1970-01-01 00:00:00')", vwap=True), "bars"))
def bars_4h(spark, sf_dir):
    return portable(barops.aggregate_bars(stored_bars(spark, sf_dir), 4, "hour"))


@query("bars_day", sql(_coarse_sql("date_trunc('day', window_start_et)", vwap=True), "bars"))
def bars_day(spark, sf_dir):
    return portable(barops.aggregate_bars(stored_bars(spark, sf_dir), 1, "day"))


@query("bars_week", sql(_coarse_sql("date_trunc('week', window_start_et)", vwap=True), "bars"))
def bars_week(spark, sf_dir):
    return portable(barops.aggregate_bars(stored_bars(spark, sf_dir), 1, "week"))


@query("bars_month", sql(_coarse_sql("date_trunc('month', window_start_et)", vwap=True), "bars"))
def bars_month(spark, sf_dir):
    return portable(barops.aggregate_bars(stored_bars(spark, sf_dir), 1, "month"))


@query("bars_quarter_year", sql(
    _coarse_sql("date_trunc('quarter', window_start_et)", vwap=True) + " UNION ALL "
    + _coarse_sql("date_trunc('year', window_start_et)", vwap=True), "bars"))
def bars_quarter_year(spark, sf_dir):
    source = stored_bars(spark, sf_dir)
    return portable(barops.aggregate_bars(source, 1, "quarter").unionByName(
        barops.aggregate_bars(source, 1, "year")))


@query("bars_latest", sql(
    _coarse_sql("date_trunc('hour', window_start_et)", vwap=True,
                where="WHERE window_start_et >= TIMESTAMP '2024-01-08 00:00:00' "
                      "AND window_start_et < TIMESTAMP '2024-01-20 00:00:00'")
    + " ORDER BY bar_start DESC, ticker LIMIT 50", "bars"))
def bars_latest(spark, sf_dir):
    return portable(barops.aggregate_bars(
        stored_bars(spark, sf_dir), 1, "hour", "2024-01-08", "2024-01-19", sort="desc", limit=50))


@query("grouped_daily", sql(_coarse_sql(
    "date_trunc('day', window_start_et)", "wide_bars", True,
    "WHERE CAST(window_start_et AS DATE) = DATE '2024-01-16'"), "wide_bars"))
def grouped_daily(spark, sf_dir):
    return portable(barops.grouped_daily(stored_bars(spark, sf_dir, wide=True), "2024-01-16"))


_SESSIONS = (
    "SELECT ticker, CAST(window_start_et AS DATE) AS trade_date, "
    "arg_min(open, window_start_et) FILTER (WHERE s = 1) AS open, max(high) FILTER (WHERE s = 1) AS high, "
    "min(low) FILTER (WHERE s = 1) AS low, arg_max(close, window_start_et) FILTER (WHERE s = 1) AS close, "
    "CAST(coalesce(sum(volume) FILTER (WHERE s = 1), 0) AS BIGINT) AS volume, "
    "arg_min(open, window_start_et) FILTER (WHERE s = 0) AS pre_market, "
    "arg_max(close, window_start_et) FILTER (WHERE s = 0) AS early_close, "
    "arg_max(close, window_start_et) FILTER (WHERE s = 2) AS after_hours "
    "FROM (SELECT *, CASE WHEN hour(window_start_et) * 60 + minute(window_start_et) < 570 THEN 0 "
    "WHEN hour(window_start_et) < 16 THEN 1 ELSE 2 END AS s FROM bars) GROUP BY 1, 2")


@query("open_close_sessions", sql(
    f"SELECT ticker, {day('trade_date')} AS trade_date, {OHLC_SQL}, volume, {r('pre_market')} AS pre_market, "
    f"{r('early_close')} AS early_close, {r('after_hours')} AS after_hours FROM sessions",
    "bars", sessions=_SESSIONS))
def open_close_sessions(spark, sf_dir):
    return portable(barops.daily_sessions(stored_bars(spark, sf_dir)))


_CHANGED = (
    "SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY trade_date) AS previous_close FROM sessions")


@query("session_change", sql(
    f"SELECT ticker, {day('trade_date')} AS trade_date, {r('previous_close')} AS previous_close, "
    f"{r('early_close - previous_close')} AS early_trading_change, "
    f"{r(ratio('(early_close - previous_close) * 100', 'previous_close'))} AS early_trading_change_percent, "
    f"{r('close - previous_close')} AS regular_trading_change, "
    f"{r(ratio('(close - previous_close) * 100', 'previous_close'))} AS regular_trading_change_percent, "
    f"{r('after_hours - close')} AS late_trading_change, "
    f"{r(ratio('(after_hours - close) * 100', 'close'))} AS late_trading_change_percent FROM changed",
    "bars", sessions=_SESSIONS, changed=_CHANGED))
def session_change(spark, sf_dir):
    changed = daily.session_change(barops.daily_sessions(stored_bars(spark, sf_dir)))
    return portable(changed.select(
        "ticker", "trade_date", "previous_close",
        *[f"{s}_trading_change{p}" for s in ("early", "regular", "late") for p in ("", "_percent")]))


@query("trading_hours", sql(
    f"SELECT ticker, {moment('window_start_et')} AS window_start_et, {r('close')} AS close, volume "
    "FROM hours_bars", "hours_bars"))
def trading_hours(spark, sf_dir):
    return portable(trading_hours_only(stored_bars(spark, sf_dir)).select(
        "ticker", "window_start_et", "close", "volume"))


@query("weekday_filter", sql(
    "SELECT ticker, CAST(isodow(window_start_et) % 7 + 1 AS BIGINT) AS weekday, "
    "CAST(hour(window_start_et) AS BIGINT) AS hour, count(*) AS n FROM bars "
    "WHERE isodow(window_start_et) <= 5 GROUP BY 1, 2, 3", "bars"))
def weekday_filter(spark, sf_dir):
    kept = stored_bars(spark, sf_dir).filter(clock.is_weekday(F.col("window_start_et")))
    return portable(kept.groupBy(
        "ticker", F.dayofweek("window_start_et").alias("weekday"), F.hour("window_start_et").alias("hour"),
    ).agg(F.count("*").alias("n")))


@query("session_labels", sql(
    "SELECT ticker, CASE WHEN hour(window_start_et) * 60 + minute(window_start_et) < 570 THEN 'pre' "
    "WHEN hour(window_start_et) < 16 THEN 'regular' ELSE 'post' END AS session, count(*) AS n "
    "FROM bars GROUP BY 1, 2", "bars"))
def session_labels(spark, sf_dir):
    return portable(stored_bars(spark, sf_dir).groupBy(
        "ticker", clock.session_of(F.col("window_start_et")).alias("session")).agg(F.count("*").alias("n")))


@query("epoch_units", sql(
    f"SELECT event_id, {moment('ts')} AS from_ns, {moment('ts')} AS from_us, {moment('ts')} AS from_ms, "
    f"{moment('ts')} AS from_s, {moment('ts - INTERVAL 5 HOUR')} AS market FROM events"))
def epoch_units(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    ns = clock.epoch_ns(F.col("ts"))
    return portable(events.select(
        "event_id", clock.utc_from_epoch(ns, "ns").alias("from_ns"),
        clock.utc_from_epoch(F.call_function("div", ns, F.lit(1000).cast("bigint")), "us").alias("from_us"),
        clock.utc_from_epoch(clock.epoch_ms(F.col("ts")), "ms").alias("from_ms"),
        clock.utc_from_epoch(F.call_function("div", ns, F.lit(1000000000).cast("bigint")), "s").alias("from_s"),
        clock.market_from_epoch(ns, "ns").alias("market")))


@query("sma", sql(
    f"SELECT ticker, {moment('window_start_et')} AS window_start_et, {r('close')} AS close, "
    "CASE WHEN count(*) OVER w = 20 THEN " + r("avg(close) OVER w") + " END AS sma FROM bars "
    "WINDOW w AS (PARTITION BY ticker ORDER BY window_start_et ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)",
    "bars"))
def sma(spark, sf_dir):
    return portable(indicators.sma(stored_bars(spark, sf_dir), 20).select(
        "ticker", "window_start_et", "close", "sma"))


@query("sma_long", sql(
    f"SELECT ticker, {moment('window_start_et')} AS window_start_et, "
    "CASE WHEN count(*) OVER w = 200 THEN " + r("avg(high) OVER w") + " END AS sma FROM bars "
    "WINDOW w AS (PARTITION BY ticker ORDER BY window_start_et ROWS BETWEEN 199 PRECEDING AND CURRENT ROW)",
    "bars"))
def sma_long(spark, sf_dir):
    return portable(indicators.sma(stored_bars(spark, sf_dir), 200, "high").select(
        "ticker", "window_start_et", "sma"))


@query("sma_with_gaps", sql(
    f"SELECT ticker, {moment('t')} AS window_start_et, CASE WHEN isnan(m) THEN -1 ELSE {r('m')} END AS sma FROM ("
    "SELECT ticker, t, CASE WHEN count(close) OVER w = 25 THEN avg(close) OVER w END AS m FROM gappy "
    "WINDOW w AS (PARTITION BY ticker ORDER BY t NULLS FIRST ROWS BETWEEN 24 PRECEDING AND CURRENT ROW))",
    "bars", gappy=(
        "SELECT ticker, CASE WHEN window_start_et > min(window_start_et) OVER (PARTITION BY ticker) THEN window_start_et END AS t, "
        "CASE WHEN volume % 40 = 7 THEN NULL WHEN volume % 50 = 11 THEN CAST('NaN' AS DOUBLE) ELSE close END AS close FROM bars")))
def sma_with_gaps(spark, sf_dir):
    """NULL and NaN prices, and a NULL time per ticker: every row stays, and NaN leaves the mean with its row."""
    base = stored_bars(spark, sf_dir)
    first = base.groupBy(F.col("ticker").alias("_t")).agg(F.min("window_start_et").alias("_first"))
    gappy = base.join(first, F.col("ticker") == F.col("_t")).select(
        "ticker", F.when(F.col("window_start_et") > F.col("_first"), F.col("window_start_et")).alias("window_start_et"),
        F.when(F.col("volume") % 40 == 7, None).when(F.col("volume") % 50 == 11, float("nan")).otherwise(F.col("close")).alias("close"))
    found = indicators.sma(gappy, 25)
    return portable(found.select("ticker", "window_start_et", F.when(F.isnan("sma"), -1.0).otherwise(F.col("sma")).alias("sma")))


@query("sma_cross", sql(
    f"SELECT ticker, {moment('window_start_et')} AS window_start_et, {r('fast')} AS fast_sma, "
    f"{r('slow')} AS slow_sma, CAST(CASE WHEN before < 0 THEN 1 ELSE -1 END AS BIGINT) AS signal FROM ("
    "SELECT *, lag(fast - slow) OVER (PARTITION BY ticker ORDER BY window_start_et) AS before FROM means) "
    "WHERE (before < 0 AND fast > slow) OR (before > 0 AND fast < slow)",
    "bars", means=(
        "SELECT ticker, window_start_et, CASE WHEN count(*) OVER f = 10 THEN avg(close) OVER f END AS fast, "
        "CASE WHEN count(*) OVER s = 40 THEN avg(close) OVER s END AS slow FROM bars WINDOW "
        "f AS (PARTITION BY ticker ORDER BY window_start_et ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), "
        "s AS (PARTITION BY ticker ORDER BY window_start_et ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)")))
def sma_cross(spark, sf_dir):
    return portable(indicators.sma_cross(stored_bars(spark, sf_dir)).select(
        "ticker", "window_start_et", "fast_sma", "slow_sma", "signal"))


_NUMBERED = (
    "SELECT ticker, window_start_et, close, row_number() OVER (PARTITION BY ticker ORDER BY window_start_et) AS n, "
    "close - lag(close) OVER (PARTITION BY ticker ORDER BY window_start_et) AS change FROM bars")


@query("ema", sql(
    f"SELECT ticker, {moment('window_start_et')} AS window_start_et, {r('ema')} AS ema FROM folded",
    "bars", recursive=True, numbered=_NUMBERED, folded=(
        "SELECT ticker, window_start_et, n, close AS ema FROM numbered WHERE n = 1 UNION ALL "
        "SELECT x.ticker, x.window_start_et, x.n, x.close * 2.0 / 21 + f.ema * 19.0 / 21 "
        "FROM folded f JOIN numbered x ON x.ticker = f.ticker AND x.n = f.n + 1")))
def ema(spark, sf_dir):
    return portable(indicators.ema(stored_bars(spark, sf_dir), 20).select("ticker", "window_start_et", "ema"))


@query("ema_of_filled_bars", sql(
    f"SELECT g.ticker, {moment('g.slot')} AS bar_start, "
    + r("last_value(f.ema IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.slot ROWS UNBOUNDED PRECEDING)")
    + " AS ema FROM grid g LEFT JOIN folded f ON f.ticker = g.ticker AND f.b = g.slot",
    "bars", recursive=True, grid=_GRID, closes5=(
        "SELECT ticker, b, close, row_number() OVER (PARTITION BY ticker ORDER BY b) AS n FROM ("
        f"SELECT ticker, {_FIVE} AS b, arg_max(close, window_start_et) AS close FROM bars GROUP BY ALL)"),
    folded=(
        "SELECT ticker, b, n, close AS ema FROM closes5 WHERE n = 1 UNION ALL "
        "SELECT x.ticker, x.b, x.n, x.close * 2.0 / 13 + f.ema * 11.0 / 13 "
        "FROM folded f JOIN closes5 x ON x.ticker = f.ticker AND x.n = f.n + 1")))
def ema_of_filled_bars(spark, sf_dir):
    """Filled slots have no price: they keep the average and do not count."""
    filled = barops.resample(stored_bars(spark, sf_dir), fill_gaps=True)
    return portable(indicators.ema(filled, 12, time="bar_start").select("ticker", "bar_start", "ema"))


@query("rsi", sql(
    f"SELECT ticker, {moment('window_start_et')} AS window_start_et, CASE WHEN n > 1 THEN "
    + r("CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END") + " END AS rsi FROM folded",
    "bars", recursive=True, numbered=_NUMBERED, folded=(
        "SELECT ticker, window_start_et, n, CAST(0 AS DOUBLE) AS gain, CAST(0 AS DOUBLE) AS loss "
        "FROM numbered WHERE n = 1 UNION ALL "
        "SELECT x.ticker, x.window_start_et, x.n, "
        "CASE WHEN x.n = 2 THEN greatest(x.change, 0) ELSE greatest(x.change, 0) / 14.0 + f.gain * 13.0 / 14 END, "
        "CASE WHEN x.n = 2 THEN greatest(-x.change, 0) ELSE greatest(-x.change, 0) / 14.0 + f.loss * 13.0 / 14 END "
        "FROM folded f JOIN numbered x ON x.ticker = f.ticker AND x.n = f.n + 1")))
def rsi(spark, sf_dir):
    return portable(indicators.rsi(stored_bars(spark, sf_dir), 14).select("ticker", "window_start_et", "rsi"))


@query("macd", sql(
    f"SELECT ticker, {moment('window_start_et')} AS window_start_et, {r('s - l')} AS macd, {r('g')} AS signal, "
    f"{r('s - l - g')} AS histogram FROM folded",
    "bars", recursive=True, numbered=_NUMBERED, folded=(
        "SELECT ticker, window_start_et, n, close AS s, close AS l, CAST(0 AS DOUBLE) AS g "
        "FROM numbered WHERE n = 1 UNION ALL "
        "SELECT x.ticker, x.window_start_et, x.n, x.close * 2.0 / 13 + f.s * 11.0 / 13, "
        "x.close * 2.0 / 27 + f.l * 25.0 / 27, ((x.close * 2.0 / 13 + f.s * 11.0 / 13) - "
        "(x.close * 2.0 / 27 + f.l * 25.0 / 27)) * 0.2 + f.g * 0.8 "
        "FROM folded f JOIN numbered x ON x.ticker = f.ticker AND x.n = f.n + 1")))
def macd(spark, sf_dir):
    return portable(indicators.macd(stored_bars(spark, sf_dir)).select(
        "ticker", "window_start_et", "macd", "signal", "histogram"))


@query("indicator_latest", sql(
    f"SELECT ticker, {moment('window_start_et')} AS window_start_et, CASE WHEN count(*) OVER w = 20 THEN "
    + r("avg(close) OVER w") + " END AS sma FROM bars WINDOW w AS (PARTITION BY ticker "
    "ORDER BY window_start_et ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) "
    "ORDER BY window_start_et DESC, ticker LIMIT 10", "bars"))
def indicator_latest(spark, sf_dir):
    found = indicators.sma(stored_bars(spark, sf_dir), 20).select("ticker", "window_start_et", "sma")
    return portable(indicators.latest_values(found))


@query("running_vwap", sql(
    f"SELECT ticker, {moment('window_start_et')} AS window_start_et, "
    "CAST(sum(volume) OVER w AS BIGINT) AS accumulated_volume, "
    f"{r(ratio('sum(close * volume) OVER w', 'sum(volume) OVER w'))} AS aggregate_vwap FROM bars "
    "WINDOW w AS (PARTITION BY ticker, CAST(window_start_et AS DATE) ORDER BY window_start_et "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "bars"))
def running_vwap(spark, sf_dir):
    return portable(indicators.running_day_vwap(stored_bars(spark, sf_dir)).select(
        "ticker", "window_start_et", "accumulated_volume", "aggregate_vwap"))


@query("running_vwap_trades", sql(
    f"SELECT ticker, sequence, CAST(sum(size) OVER w AS BIGINT) AS accumulated_volume, "
    f"{r(ratio('sum(price * size) OVER w', 'sum(size) OVER w'))} AS aggregate_vwap FROM trades "
    "WINDOW w AS (PARTITION BY ticker, CAST(ts_et AS DATE) ORDER BY ts_et, sequence "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "trades"))
def running_vwap_trades(spark, sf_dir):
    return portable(indicators.running_day_vwap_of_trades(trades(spark, sf_dir)).select(
        "ticker", "sequence", "accumulated_volume", "aggregate_vwap"))


_PREVIOUS = "SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY trade_date) AS previous_close FROM day_bars"


@query("prev_close", sql(
    f"SELECT ticker, {day('trade_date')} AS trade_date, {r('close')} AS close, "
    f"{r('previous_close')} AS previous_close, {r('close - previous_close')} AS change, "
    f"{r(ratio('(close - previous_close) * 100', 'previous_close'))} AS change_percent FROM previous",
    "day_bars", previous=_PREVIOUS))
def prev_close(spark, sf_dir):
    return portable(snapshot.previous_close(stored_bars(spark, sf_dir)).select(
        "ticker", "trade_date", "close", "previous_close", "change", "change_percent"))


def _movers_sql(direction: str) -> str:
    days = ("SELECT ticker, CAST(window_start_et AS DATE) AS trade_date, "
            "arg_max(close, window_start_et) AS close FROM wide_bars GROUP BY 1, 2")
    moved = ("SELECT *, lag(close) OVER (PARTITION BY ticker ORDER BY trade_date) AS previous_close FROM days")
    return sql(
        f"SELECT ticker, {r('close')} AS close, {r('previous_close')} AS previous_close, "
        f"{r('(close - previous_close) * 100 / previous_close')} AS change_percent FROM moved "
        "WHERE trade_date = DATE '2024-01-16' AND previous_close <> 0 "
        f"ORDER BY (close - previous_close) * 100 / previous_close {direction}, ticker LIMIT 20",
        "wide_bars", days=days, moved=moved)


def _movers(spark, sf_dir, direction):
    days = barops.aggregate_bars(stored_bars(spark, sf_dir, wide=True), 1, "day", end="2024-01-16").withColumn(
        "trade_date", F.to_date("bar_start"))
    return portable(daily.top_movers(days, "2024-01-16", direction).select(
        "ticker", "close", "previous_close", "change_percent"))


@query("top_gainers", _movers_sql("DESC"))
def top_gainers(spark, sf_dir):
    return _movers(spark, sf_dir, "gainers")


@query("top_losers", _movers_sql("ASC"))
def top_losers(spark, sf_dir):
    return _movers(spark, sf_dir, "losers")


@query("latest_trade", sql(
    f"SELECT ticker, {moment('max(ts)')} AS ts, arg_max(sequence, (ts, sequence)) AS sequence, "
    f"{r('arg_max(price, (ts, sequence))')} AS price, arg_max(size, (ts, sequence)) AS size "
    "FROM wide_trades GROUP BY ticker", "wide_trades"))
def latest_trade(spark, sf_dir):
    return portable(snapshot.last_trade(trades(spark, sf_dir, wide=True)).select(
        "ticker", "ts", "sequence", "price", "size"))


@query("latest_quote", sql(
    f"SELECT ticker, arg_max(sequence, (ts, sequence)) AS sequence, "
    f"{r('arg_max(bid_price, (ts, sequence))')} AS bid_price, "
    f"{r('arg_max(ask_price, (ts, sequence))')} AS ask_price, "
    f"{r('arg_max((bid_price + ask_price) / 2, (ts, sequence))')} AS midpoint FROM quotes GROUP BY ticker",
    "quotes"))
def latest_quote(spark, sf_dir):
    from barloom.operators.refdata import market_midpoint
    return portable(market_midpoint(snapshot.last_quote(quotes(spark, sf_dir))).select(
        "ticker", "sequence", "bid_price", "ask_price", "midpoint"))


@query("ticker_snapshot", sql(
    f"SELECT p.ticker, {day('p.trade_date')} AS day, {r('p.close')} AS day_close, p.volume AS day_volume, "
    f"{r('p.previous_close')} AS prev_close, {moment('m.window_start_et')} AS min_start, {r('m.close')} AS min_close, "
    f"{r('t.price')} AS last_price, {r('t.price - 0.05')} AS last_bid, {r('t.price + 0.05')} AS last_ask, "
    f"{r('t.price - p.previous_close')} AS todays_change, "
    f"{r(ratio('(t.price - p.previous_close) * 100', 'p.previous_close'))} AS todays_change_percent "
    "FROM (SELECT * FROM previous QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) = 1) p "
    "JOIN (SELECT * FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY window_start_et DESC) = 1) m "
    "ON m.ticker = p.ticker JOIN (SELECT * FROM trades QUALIFY row_number() OVER (PARTITION BY ticker "
    "ORDER BY ts DESC, sequence DESC) = 1) t ON t.ticker = p.ticker", "day_bars", previous=_PREVIOUS))
def ticker_snapshot(spark, sf_dir):
    snap = snapshot.ticker_snapshot(stored_bars(spark, sf_dir), trades(spark, sf_dir), quotes(spark, sf_dir))
    return portable(snap.select(
        "ticker", F.col("day.trade_date").alias("day"), F.col("day.close").alias("day_close"),
        F.col("day.volume").alias("day_volume"), F.col("prev_day.close").alias("prev_close"),
        F.col("min.window_start_et").alias("min_start"), F.col("min.close").alias("min_close"),
        F.col("last_trade.price").alias("last_price"), F.col("last_quote.bid_price").alias("last_bid"),
        F.col("last_quote.ask_price").alias("last_ask"), "todays_change", "todays_change_percent"))


_SPLITS = ("SELECT ticker, CAST(d AS DATE) AS execution_date, CAST(f AS DOUBLE) AS split_from, "
           "CAST(t AS DOUBLE) AS split_to FROM (VALUES ('CLICK', '2024-01-10', 1, 2), "
           "('CLICK', '2024-01-20', 1, 5), ('VIEW', '2024-01-15', 10, 1)) AS v(ticker, d, f, t)")


@query("split_adjusted_bars", sql(
    f"SELECT b.ticker, {moment('b.window_start_et')} AS window_start_et, {r('b.close * f')} AS close, "
    f"{r('b.high * f')} AS high, {r('b.volume / f')} AS volume, {r('f')} AS split_factor FROM ("
    "SELECT bars.*, coalesce((SELECT product(split_from / split_to) FROM splits s WHERE s.ticker = bars.ticker "
    "AND CAST(bars.window_start_et AS DATE) < s.execution_date), 1.0) AS f FROM bars) b",
    "bars", splits=_SPLITS))
def split_adjusted_bars(spark, sf_dir):
    return portable(adjust.split_adjusted(stored_bars(spark, sf_dir), spark.sql(_SPLITS)).select(
        "ticker", "window_start_et", "close", "high", "volume", "split_factor"))


_RENAMES = ("SELECT instrument, CAST(d AS DATE) AS date, ticker FROM (VALUES (1, '2000-01-01', 'SIGNUP'), "
            "(1, '2024-01-12', 'JOIN'), (2, '2000-01-01', 'BUY'), (2, '2023-06-01', 'PURCHASE'), "
            "(2, '2024-01-20', 'PAY')) AS v(instrument, d, ticker)")


@query("symbol_rename", sql(
    "SELECT ticker, current_ticker, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM (SELECT b.*, "
    "CASE WHEN ticker = 'SIGNUP' AND window_start_et < TIMESTAMP '2024-01-12 00:00:00' THEN 'JOIN' "
    "WHEN ticker = 'PURCHASE' AND window_start_et < TIMESTAMP '2024-01-20 00:00:00' THEN 'PAY' "
    "ELSE ticker END AS current_ticker FROM bars b) GROUP BY 1, 2", "bars"))
def symbol_rename(spark, sf_dir):
    named = adjust.current_symbols(stored_bars(spark, sf_dir), spark.sql(_RENAMES))
    return portable(named.groupBy("ticker", "current_ticker").agg(
        F.count("*").alias("n"), F.sum("volume").alias("volume")))


_HOLIDAYS = ("SELECT exchange, CAST(d AS DATE) AS date, status, close FROM (VALUES "
             "('NYSE', '2024-01-01', 'closed', NULL), ('NYSE', '2024-01-15', 'closed', NULL), "
             "('NYSE', '2024-01-19', 'early-close', '13:00'), ('OTC', '2024-01-16', 'closed', NULL)) "
             "AS v(exchange, d, status, close)")


@query("calendar_filter", sql(
    f"SELECT ticker, {day('CAST(window_start_et AS DATE)')} AS trade_date, count(*) AS n FROM bars b WHERE NOT EXISTS ("
    "SELECT 1 FROM holidays h WHERE h.exchange = 'NYSE' AND h.date = CAST(b.window_start_et AS DATE) "
    "AND (h.status = 'closed' OR strftime(b.window_start_et, '%H:%M') >= h.close)) GROUP BY 1, 2",
    "bars", holidays=_HOLIDAYS))
def calendar_filter(spark, sf_dir):
    kept = adjust.on_trading_calendar(stored_bars(spark, sf_dir), spark.sql(_HOLIDAYS), "NYSE")
    return portable(kept.groupBy("ticker", F.to_date("window_start_et").alias("trade_date")).agg(
        F.count("*").alias("n")))


_ALL_EVENTS = f"SELECT ticker, {moment('ts')} AS ts, {r('price')} AS price, size, sequence FROM trades"


@query("dedup_rows", sql(_ALL_EVENTS, "trades"))
def dedup_rows(spark, sf_dir):
    one = trades(spark, sf_dir).select("ticker", "ts", "price", "size", "sequence")
    return portable(rows.distinct_rows(rows.stack([one, one, one])))


@query("dedup_keys", sql(
    "SELECT ticker, day, price, sequence FROM (SELECT ticker, " + day("ts") + " AS day, " + r("price")
    + " AS price, sequence, row_number() OVER (PARTITION BY ticker, CAST(ts AS DATE) "
    "ORDER BY ts DESC, sequence DESC) AS n FROM wide_trades) WHERE n = 1", "wide_trades"))
def dedup_keys(spark, sf_dir):
    dated = trades(spark, sf_dir, wide=True).withColumn("day", F.to_date("ts"))
    return portable(rows.distinct_keys(dated, ["ticker", "day"], ["ts", "sequence"]).select(
        "ticker", "day", "price", "sequence"))


@query("stack_rows", sql(
    "SELECT ticker, count(*) AS n, count(venue) AS with_venue FROM (SELECT ticker, NULL AS venue FROM trades "
    "UNION ALL SELECT ticker, 'wide' FROM wide_trades) GROUP BY 1", "trades", "wide_trades"))
def stack_rows(spark, sf_dir):
    stacked = rows.stack([
        trades(spark, sf_dir), trades(spark, sf_dir, wide=True).withColumn("venue", F.lit("wide"))])
    return portable(stacked.groupBy("ticker").agg(
        F.count("*").alias("n"), F.count("venue").alias("with_venue")))


@query("missing_tickers", sql(
    "SELECT DISTINCT ticker FROM wide_trades EXCEPT SELECT 'U' || c_custkey FROM customer WHERE c_acctbal > 0",
    "wide_trades"))
def missing_tickers(spark, sf_dir):
    stored = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(
        F.concat(F.lit("U"), F.col("c_custkey")).alias("ticker"))
    return portable(rows.missing_keys(trades(spark, sf_dir, wide=True), stored, ["ticker"]))


@query("subscription_reconcile", sql(
    "SELECT topic, sym, 'add' AS action FROM (SELECT * FROM wanted EXCEPT SELECT * FROM active) UNION ALL "
    "SELECT topic, sym, 'remove' FROM (SELECT * FROM active EXCEPT SELECT * FROM wanted)",
    "wide_trades", wanted="SELECT DISTINCT 'T' AS topic, ticker AS sym FROM wide_trades WHERE price > 50",
    active="SELECT DISTINCT 'T' AS topic, ticker AS sym FROM wide_trades WHERE size > 95"))
def subscription_reconcile(spark, sf_dir):
    every = trades(spark, sf_dir, wide=True)
    keys = [F.lit("T").alias("topic"), F.col("ticker").alias("sym")]
    return portable(rows.reconcile(
        every.filter("price > 50").select(*keys), every.filter("size > 95").select(*keys)))


@query("head_rows", sql(_ALL_EVENTS + " ORDER BY trades.ts, sequence LIMIT 5", "trades"))
def head_rows(spark, sf_dir):
    return portable(rows.head(trades(spark, sf_dir).select(
        "ticker", "ts", "price", "size", "sequence"), 5, ["ts", "sequence"]))


@query("sorted_limit", sql(_ALL_EVENTS + " ORDER BY trades.price DESC, sequence LIMIT 100", "trades"))
def sorted_limit(spark, sf_dir):
    return portable(rows.sorted_limit(trades(spark, sf_dir).select(
        "ticker", "ts", "price", "size", "sequence"), "price", "desc", 100, ["sequence"]))
