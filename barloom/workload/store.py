"""Flat-file ingest, the bar store and its maintenance, on bars derived from events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from barloom import schemas
from barloom.functions import clock
from barloom.operators import stats
from barloom.operators.rows import stack
from barloom.plans import ingest, maintain
from barloom.plans.barquery import BarQuery
from barloom.session import work_dir
from barloom.sources import flatfiles
from barloom.sources.barstore import BarStore, map_chunks
from barloom.sources.versions import Versions
from barloom.workload import query
from barloom.workload.inputs import BASE, TICKERS, bars, corr, moment, once, portable, r, ratio, sql, table

_BAR_SQL = (f"ticker, {moment('window_start_et')} AS window_start_et, {r('open')} AS open, {r('high')} AS high, "
            f"{r('low')} AS low, {r('close')} AS close, volume, transactions, year")
_ROWS_SQL = f"SELECT {_BAR_SQL} FROM hours_bars"


def raw_bars(spark, sf_dir):
    """Minute bars in the raw layout: epoch nanoseconds, columns in flat-file order."""
    utc = clock.to_utc(F.col("window_start_et"))
    return bars(spark, sf_dir).withColumn("window_start", clock.epoch_ns(utc)).select(
        *schemas.RAW_BAR_COLUMNS)


def flat_files(spark, sf_dir) -> str:
    return once(spark, sf_dir, "flat", lambda target: raw_bars(spark, sf_dir).write.option(
        "header", True).option("compression", "gzip").csv(target))


def store(spark, sf_dir) -> BarStore:
    source = flat_files(spark, sf_dir)
    return BarStore(spark, once(
        spark, sf_dir, "store", lambda target: ingest.ingest_bars(spark, source, target)))


def _clean(df):
    return portable(df.select(*schemas.CLEAN_BAR_COLUMNS))


@query("ingest_roundtrip", sql(_ROWS_SQL, "hours_bars"))
def ingest_roundtrip(spark, sf_dir):
    target = work_dir(spark, "roundtrip")
    ingest.ingest_bars(spark, flat_files(spark, sf_dir), target)
    return _clean(BarStore(spark, target).scan())


@query("ingest_idempotent", sql(
    "SELECT (SELECT count(*) FROM hours_bars) AS rows_after_first, (SELECT count(*) FROM hours_bars) AS rows_after_second, "
    "CAST(0 AS BIGINT) AS written_again, (SELECT count(DISTINCT ticker) FROM hours_bars) AS tickers", "hours_bars"))
def ingest_idempotent(spark, sf_dir):
    source, target = flat_files(spark, sf_dir), work_dir(spark, "idempotent")
    first = ingest.ingest_bars(spark, source, target)
    second = ingest.ingest_bars(spark, source, target)
    return portable(BarStore(spark, target).scan().agg(F.count("*").alias("rows_after_second")).select(
        F.lit(first.rows_written).cast("bigint").alias("rows_after_first"), "rows_after_second",
        F.lit(second.rows_written).cast("bigint").alias("written_again"),
        F.lit(first.tickers_written).cast("bigint").alias("tickers")))


@query("ingest_missing_only", sql(_ROWS_SQL, "hours_bars"))
def ingest_missing_only(spark, sf_dir):
    """A first load of two tickers, then all: only the missing tickers are added."""
    source, target = flat_files(spark, sf_dir), work_dir(spark, "missing")
    ingest.ingest_bars(spark, source, target, tickers=["VIEW", "CLICK"])
    ingest.ingest_bars(spark, source, target)
    return _clean(BarStore(spark, target).scan())


@query("raw_scan_declared", sql(
    f"SELECT ticker, {moment('window_start_et')} AS window_start_et, {r('close')} AS close, volume FROM bars", "bars"))
def raw_scan_declared(spark, sf_dir):
    raw = flatfiles.read_raw_bars_declared(spark, flat_files(spark, sf_dir))
    return portable(ingest.with_market_time(raw).select("ticker", "window_start_et", "close", "volume"))


@query("raw_scan_recursive", sql(
    "SELECT ticker, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume FROM bars WHERE ticker IN ('VIEW', 'ERROR') "
    "GROUP BY 1", "bars"))
def raw_scan_recursive(spark, sf_dir):
    raw = flatfiles.read_raw_bars(
        spark, flat_files(spark, sf_dir), recursive=True, name_glob="*.csv.gz", tickers=["VIEW", "ERROR"])
    return portable(raw.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("volume").alias("volume")))


@query("csv_to_parquet", sql(
    f"SELECT ticker, epoch_ns(window_start_et + INTERVAL 5 HOUR) AS window_start, {r('close')} AS close FROM bars", "bars"))
def csv_to_parquet(spark, sf_dir):
    return portable(flatfiles.convert_flat_file(
        spark, flat_files(spark, sf_dir), work_dir(spark, "converted")).select("ticker", "window_start", "close"))


@query("get_bars", sql(
    _ROWS_SQL + " WHERE ticker IN ('VIEW', 'CLICK') AND window_start_et >= TIMESTAMP '2024-01-03 00:00:00' "
    "AND window_start_et < TIMESTAMP '2024-01-13 00:00:00' ORDER BY hours_bars.window_start_et, ticker", "hours_bars"))
def get_bars(spark, sf_dir):
    return _clean(store(spark, sf_dir).get_bars(
        ["view", "click"], start_date="2024-01-03", end_date="2024-01-12", ordered=True))


@query("get_bars_years", sql(_ROWS_SQL + " WHERE year IN (2022, 2024)", "hours_bars"))
def get_bars_years(spark, sf_dir):
    return _clean(store(spark, sf_dir).get_bars(years=[2022, 2024]))


@query("get_bars_columns", sql(
    f"SELECT {moment('window_start_et')} AS window_start_et, ticker, {r('close')} AS close, volume FROM hours_bars "
    "WHERE CAST(window_start_et AS DATE) = DATE '2024-01-10'", "hours_bars"))
def get_bars_columns(spark, sf_dir):
    return portable(store(spark, sf_dir).get_bars(
        start_date="2024-01-10", end_date="2024-01-10",
        columns=["window_start_et", "ticker", "close", "volume"]))


@query("get_bars_partitions", sql(_ROWS_SQL + " WHERE year = 2024 AND ticker IN ('VIEW', 'ERROR')", "hours_bars"))
def get_bars_partitions(spark, sf_dir):
    return _clean(store(spark, sf_dir).scan_partitions([(2024, "VIEW"), (2024, "ERROR"), (1999, "VIEW")]))


# Tickers whose folder names are escaped.
ODD_NAMES = {"VIEW": "BRK/A", "CLICK": "A B", "ERROR": "50%:X=1"}


@query("get_bars_paths", sql(
    "SELECT CASE ticker WHEN 'VIEW' THEN 'BRK/A' WHEN 'CLICK' THEN 'A B' ELSE '50%:X=1' END AS ticker, "
    f"{moment('window_start_et')} AS window_start_et, {r('close')} AS close, year FROM hours_bars "
    "WHERE ticker IN ('VIEW', 'CLICK', 'ERROR') AND year = 2024", "hours_bars"))
def get_bars_paths(spark, sf_dir):
    """Bars by the folders of a selection, with tickers that a folder name cannot hold as they are."""
    named = F.create_map(*[F.lit(x) for pair in ODD_NAMES.items() for x in pair])
    target = work_dir(spark, "odd-names")
    store(spark, sf_dir).scan().withColumn("ticker", F.coalesce(named[F.col("ticker")], "ticker")).write.partitionBy(
        "year", "ticker").parquet(target)
    folders = BarQuery.build([*ODD_NAMES.values(), "NONE"], 2024, exact_case=True).partition_paths(target)
    return portable(BarStore(spark, target).scan_paths(folders).select("ticker", "window_start_et", "close", "year"))


@query("partition_exists", sql(
    "SELECT w.year, w.ticker, EXISTS (SELECT 1 FROM hours_bars b WHERE b.year = w.year AND b.ticker = w.ticker) AS present "
    "FROM (VALUES (2024, 'VIEW'), (2024, 'NONE'), (1999, 'VIEW'), (2024, 'ERROR')) w(year, ticker)", "hours_bars"))
def partition_exists(spark, sf_dir):
    held = store(spark, sf_dir)
    wanted = [(2024, "VIEW"), (2024, "NONE"), (1999, "VIEW"), (2024, "ERROR")]
    return spark.createDataFrame([(y, t, held.exists(y, t)) for y, t in wanted], "year INT, ticker STRING, present BOOLEAN")


@query("to_sql_roundtrip", sql(
    f"SELECT ticker, {moment('window_start_et')} AS window_start_et, {r('close')} AS close FROM hours_bars "
    "WHERE ticker IN ('PURCHASE', 'VIEW') AND window_start_et >= TIMESTAMP '2024-01-08 00:00:00' "
    "AND window_start_et < TIMESTAMP '2024-01-17 00:00:00' ORDER BY hours_bars.window_start_et, ticker", "hours_bars"))
def to_sql_roundtrip(spark, sf_dir):
    return portable(store(spark, sf_dir).get_bars_sql(
        ordered=True, tickers=["PURCHASE", "view"], start_date="2024-01-08", end_date="2024-01-16",
        columns=["ticker", "window_start_et", "close"]))


@query("partition_list", sql(
    "SELECT year, ticker, CAST(1 AS BIGINT) AS files FROM hours_bars GROUP BY 1, 2", "hours_bars"))
def partition_list(spark, sf_dir):
    return portable(store(spark, sf_dir).partitions().select("year", "ticker", "files"))


@query("partition_list_ticker", sql(
    "SELECT DISTINCT year, ticker FROM hours_bars WHERE ticker = 'VIEW'", "hours_bars"))
def partition_list_ticker(spark, sf_dir):
    return portable(store(spark, sf_dir).partitions(ticker="view").select("year", "ticker"))


@query("available_tickers", sql(
    "SELECT DISTINCT ticker FROM hours_bars WHERE year = 2024 ORDER BY 1", "hours_bars"))
def available_tickers(spark, sf_dir):
    return portable(store(spark, sf_dir).tickers(2024))


@query("available_years", sql("SELECT DISTINCT year FROM hours_bars ORDER BY 1", "hours_bars"))
def available_years(spark, sf_dir):
    return portable(store(spark, sf_dir).years())


@query("health_profile", sql(
    "SELECT 'healthy' AS status, (SELECT count(*) FROM (SELECT DISTINCT year, ticker FROM hours_bars)) AS partitions, "
    "count(*) AS rows, CAST(0 AS BIGINT) AS null_keys, CAST(0 AS BIGINT) AS duplicate_keys, "
    f"{moment('min(window_start_et)')} AS first_bar, {moment('max(window_start_et)')} AS last_bar, '' AS issues "
    "FROM hours_bars", "hours_bars"))
def health_profile(spark, sf_dir):
    return portable(store(spark, sf_dir).health().select(
        "status", "partitions", "rows", "null_keys", "duplicate_keys", "first_bar", "last_bar",
        F.array_join("issues", ";").alias("issues")))


@query("health_of_duplicates", sql(
    "SELECT 2 * count(*) AS rows, count(*) AS duplicate_keys FROM bars", "bars"))
def health_of_duplicates(spark, sf_dir):
    from barloom.sources.barstore import profile_bars
    single = bars(spark, sf_dir)
    return portable(profile_bars(stack([single, single])).select("rows", "duplicate_keys"))


def _doubled_store(spark, sf_dir, label):
    target = work_dir(spark, label)
    single = store(spark, sf_dir).scan()
    ingest.write_bars(single, target)
    ingest.write_bars(single, target)
    return target


@query("compaction", sql(_ROWS_SQL, "hours_bars"))
def compaction(spark, sf_dir):
    target = _doubled_store(spark, sf_dir, "compaction")
    maintain.compact(spark, target)
    return _clean(BarStore(spark, target).scan())


@query("compaction_report", sql(
    "SELECT 2 * count(*) AS rows_before, count(*) AS rows_after, "
    "2 * count(DISTINCT (year, ticker)) AS files_before, count(DISTINCT (year, ticker)) AS files_after "
    "FROM hours_bars WHERE year = 2024 AND ticker IN ('VIEW', 'CLICK')", "hours_bars"))
def compaction_report(spark, sf_dir):
    target = _doubled_store(spark, sf_dir, "compaction")
    report = maintain.compact(spark, target, year=2024, tickers=["VIEW", "CLICK"])
    left = BarStore(spark, target).scan().filter("year = 2024 AND ticker IN ('VIEW', 'CLICK')")
    return portable(left.agg(F.count("*").alias("rows_after")).select(
        F.lit(report.rows_before).cast("bigint").alias("rows_before"), "rows_after",
        F.lit(report.files_before).cast("bigint").alias("files_before"),
        F.lit(report.files_after).cast("bigint").alias("files_after")))


_COUNTS = "ticker, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume"


@query("store_as_of", sql(
    f"SELECT 'first' AS state, {_COUNTS} FROM hours_bars WHERE ticker IN ('VIEW', 'CLICK') GROUP BY ticker "
    f"UNION ALL SELECT 'doubled', ticker, 2 * count(*), CAST(2 * sum(volume) AS BIGINT) FROM hours_bars GROUP BY ticker "
    f"UNION ALL SELECT 'compacted', {_COUNTS} FROM hours_bars GROUP BY ticker", "hours_bars"))
def store_as_of(spark, sf_dir):
    """One store at three of its versions: two tickers, every bar twice, and compacted."""
    target, single = work_dir(spark, "as-of"), store(spark, sf_dir).scan()
    ingest.write_bars(single.where("ticker IN ('VIEW', 'CLICK')"), target)
    states = {"first": Versions(spark, target).adopt()}
    ingest.write_bars(single, target)
    ingest.write_bars(single.where("ticker NOT IN ('VIEW', 'CLICK')"), target)
    states["doubled"] = Versions(spark, target).latest()
    maintain.compact(spark, target, keep_versions=len(states) + 2)
    states["compacted"] = None
    return portable(stack([
        BarStore(spark, target, version=number).scan().groupBy("ticker").agg(
            F.count("*").alias("n"), F.sum("volume").alias("volume")).select(F.lit(state).alias("state"), "*")
        for state, number in states.items()]))


# A ticker with a slash and one with a space must not be taken for damage.
_ODD_NAMES = "CASE ticker WHEN 'SIGNUP' THEN 'SIGN/UP' WHEN 'CLICK' THEN 'CL ICK' ELSE ticker END"


def _store_with_odd_names(spark, sf_dir, label):
    """A store with two odd tickers and one file of text in it."""
    target = work_dir(spark, label)
    ingest.write_bars(store(spark, sf_dir).scan().withColumn("ticker", F.expr(_ODD_NAMES)), target)
    bars(spark, sf_dir).filter("ticker = 'VIEW'").select(F.to_json(F.struct("*"))).write.text(f"{target}-text")
    _copy_as_parquet(spark, f"{target}-text", f"{target}/year=2024/ticker=VIEW")
    return target


@query("corrupt_repair", sql(f"SELECT * REPLACE ({_ODD_NAMES} AS ticker) FROM ({_ROWS_SQL})", "hours_bars"))
def corrupt_repair(spark, sf_dir):
    """The damaged file is found, and its partition rebuilt from the flat files."""
    target = _store_with_odd_names(spark, sf_dir, "repair")
    maintain.repair(spark, target, flat_files(spark, sf_dir))
    return _clean(BarStore(spark, target).scan())


def _copy_as_parquet(spark, source, folder):
    """Copy one text file into a store partition under a Parquet name (fixture of a damaged file)."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    origin = hadoop.Path(source)
    system = origin.getFileSystem(conf)
    part = next(s.getPath() for s in system.listStatus(origin) if s.getPath().getName().startswith("part-"))
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(
        system, part, system, hadoop.Path(f"{folder}/part-damaged.parquet"), False, conf)


@query("corrupt_list", "SELECT DISTINCT CAST(2024 AS BIGINT) AS year, 'VIEW' AS ticker FROM events WHERE event_type = 'view'")
def corrupt_list(spark, sf_dir):
    target = _store_with_odd_names(spark, sf_dir, "corrupt")
    return portable(maintain.corrupt_files(spark, target, deep=True).select("year", "ticker"))


@query("ingest_dirty", "SELECT CASE WHEN l_linenumber > 3 THEN NULL WHEN l_linenumber = 1 THEN 9007199254740993 + l_orderkey "
       "ELSE CAST(floor(l_quantity) AS BIGINT) END AS volume, count(*) AS n FROM lineitem GROUP BY 1")
def ingest_dirty(spark, sf_dir):
    """Flat files with volumes beyond 2^53, with fractions, not a number, out of range and empty."""
    line = table(spark, sf_dir, "lineitem")
    number = F.col("l_linenumber")
    text = F.when(number == 1, (F.lit(9007199254740993) + F.col("l_orderkey")).cast("string")).when(
        number <= 3, F.concat(F.col("l_quantity").cast("bigint").cast("string"), F.lit(".75"))).when(
        number == 4, "NaN").when(number == 5, "1e30").when(number == 6, "").otherwise("many")
    target = work_dir(spark, "dirty")
    line.select(F.concat(F.lit("P"), F.col("l_partkey")).alias("ticker"), text.alias("volume"), *[
        F.col("l_extendedprice").alias(c) for c in ("open", "close", "high", "low")],
        F.lit(1738767123000000000).alias("window_start"), number.alias("transactions")).write.option("header", True).csv(target)
    return portable(flatfiles.read_raw_bars(spark, target).groupBy("volume").agg(F.count("*").alias("n")))


@query("chunked_read", sql(
    f"SELECT ticker, count(*) AS n, CAST(sum(volume) AS BIGINT) AS volume, {r('sum(close)')} AS close "
    "FROM hours_bars WHERE window_start_et >= TIMESTAMP '2024-01-02 00:00:00' "
    "AND window_start_et < TIMESTAMP '2024-01-25 00:00:00' GROUP BY 1", "hours_bars"))
def chunked_read(spark, sf_dir):
    """Partial sums per piece of 100 rows, computed on executors and added up."""
    def totals(piece: pd.DataFrame) -> pd.DataFrame:
        return piece.groupby("ticker", as_index=False).agg(
            n=("close", "size"), volume=("volume", "sum"), close=("close", "sum"))

    picked = store(spark, sf_dir).get_bars(
        start_date="2024-01-02", end_date="2024-01-24", columns=["ticker", "close", "volume"])
    pieces = map_chunks(picked, totals, "ticker STRING, n BIGINT, volume BIGINT, close DOUBLE", 100)
    return portable(pieces.groupBy("ticker").agg(
        F.sum("n").alias("n"), F.sum("volume").alias("volume"), F.sum("close").alias("close")))


@query("indexed_scan", sql(_ROWS_SQL + " WHERE ticker = 'SIGNUP'", "hours_bars"))
def indexed_scan(spark, sf_dir):
    """Range-sorted files searched by ticker through row-group statistics."""
    target = once(spark, sf_dir, "indexed", lambda path: ingest.write_indexed(
        store(spark, sf_dir).scan(), path))
    return _clean(spark.read.parquet(target).filter(F.col("ticker") == "SIGNUP"))


@query("day_store", sql(
    f"SELECT ticker, {moment('window_start_et')} AS window_start_et, {r('close')} AS close, volume, "
    "'1-min' AS timeframe FROM bars WHERE hour(window_start_et) * 60 + minute(window_start_et) BETWEEN 570 AND 959 "
    "AND ticker IN ('VIEW', 'ERROR')", "bars"))
def day_store(spark, sf_dir):
    """Loading the same days twice replaces them."""
    target = work_dir(spark, "days")
    for _ in range(2):
        ingest.ingest_day_files(spark, flat_files(spark, sf_dir), target, ["VIEW", "ERROR"])
    return portable(spark.read.parquet(target).select("ticker", "window_start_et", "close", "volume", "timeframe"))


@query("date_layout", sql(
    f"SELECT ticker, {moment('window_start_et')} AS window_start_et, {r('close')} AS close FROM hours_bars "
    "WHERE CAST(window_start_et AS DATE) = DATE '2024-01-17'", "hours_bars"))
def date_layout(spark, sf_dir):
    target = once(spark, sf_dir, "dates", lambda path: ingest.write_bars_by_date(
        store(spark, sf_dir).scan(), path))
    return portable(spark.read.parquet(target).filter("trade_date = DATE'2024-01-17'").select(
        "ticker", "window_start_et", "close"))


@query("rejected_rows", sql(
    "SELECT count(*) FILTER (WHERE volume = 0) AS rejected, count(*) FILTER (WHERE volume <> 0) AS kept FROM bars", "bars"))
def rejected_rows(spark, sf_dir):
    raw = raw_bars(spark, sf_dir).withColumn("ticker", F.when(F.col("volume") != 0, F.col("ticker")).otherwise(""))
    return portable(ingest.rejected_rows(raw).agg(F.count("*").alias("rejected")).withColumn(
        "kept", ingest.valid_rows(raw).agg(F.count("*")).scalar()))


@query("query_intersection", sql(_ROWS_SQL + " WHERE year = 2024 AND window_start_et < TIMESTAMP '2024-01-06 00:00:00'",
                                 "hours_bars"))
def query_intersection(spark, sf_dir):
    """A year list and a date range over two years: both are honoured."""
    picked = BarQuery.build(years=[2024], start_date="2023-12-29", end_date="2024-01-05")
    return _clean(picked.apply(store(spark, sf_dir).scan()))


# The comparison cases of the client: tickers x days, and a column subset.
_WEEK = "window_start_et >= TIMESTAMP '2024-01-08 00:00:00' AND window_start_et < TIMESTAMP '2024-01-17 00:00:00'"
_DAY = "CAST(window_start_et AS DATE) = DATE '2024-01-08'"


@query("one_ticker_one_day", sql(f"{_ROWS_SQL} WHERE ticker = 'VIEW' AND {_DAY}", "hours_bars"))
def one_ticker_one_day(spark, sf_dir):
    return _clean(store(spark, sf_dir).get_bars("VIEW", start_date="2024-01-08", end_date="2024-01-08"))


@query("three_tickers_one_day", sql(
    f"{_ROWS_SQL} WHERE ticker IN ('VIEW', 'CLICK', 'ERROR') AND {_DAY}", "hours_bars"))
def three_tickers_one_day(spark, sf_dir):
    return _clean(store(spark, sf_dir).get_bars(
        ["VIEW", "CLICK", "ERROR"], start_date="2024-01-08", end_date="2024-01-08"))


@query("one_ticker_nine_days", sql(f"{_ROWS_SQL} WHERE ticker = 'VIEW' AND {_WEEK}", "hours_bars"))
def one_ticker_nine_days(spark, sf_dir):
    return _clean(store(spark, sf_dir).get_bars("VIEW", start_date="2024-01-08", end_date="2024-01-16"))


@query("two_tickers_nine_days", sql(f"{_ROWS_SQL} WHERE ticker IN ('VIEW', 'CLICK') AND {_WEEK}", "hours_bars"))
def two_tickers_nine_days(spark, sf_dir):
    return _clean(store(spark, sf_dir).get_bars(
        ["VIEW", "CLICK"], start_date="2024-01-08", end_date="2024-01-16"))


@query("column_subset_one_day", sql(
    f"SELECT ticker, {moment('window_start_et')} AS window_start_et, {r('close')} AS close, volume "
    f"FROM hours_bars WHERE ticker = 'VIEW' AND {_DAY}", "hours_bars"))
def column_subset_one_day(spark, sf_dir):
    return portable(store(spark, sf_dir).get_bars(
        "VIEW", start_date="2024-01-08", end_date="2024-01-08",
        columns=["ticker", "window_start_et", "close", "volume"]))


def _span(spark, sf_dir):
    return store(spark, sf_dir).get_bars(TICKERS, start_date="2024-01-08", end_date="2024-01-16")


@query("span_statistics", sql(
    f"SELECT ticker, count(*) AS data_points, {r('avg(close)')} AS avg_price, "
    f"{r('stddev_samp(close)')} AS price_volatility, {r('avg(volume)')} AS avg_volume, "
    f"{r('min(low)')} AS min_price, {r('max(high)')} AS max_price, "
    f"{r('quantile_cont(close, 0.5)')} AS median_price, {r('quantile_cont(close, 0.25)')} AS q1_price, "
    f"{r('quantile_cont(close, 0.75)')} AS q3_price, {r(corr('close', 'volume'))} AS price_volume_correlation "
    f"FROM hours_bars WHERE {_WEEK} GROUP BY ticker ORDER BY ticker", "hours_bars"))
def span_statistics(spark, sf_dir):
    """Statistics of listed tickers over nine days of the store."""
    return portable(stats.ticker_statistics(_span(spark, sf_dir)).orderBy("ticker"))


@query("span_vwap", sql(
    f"SELECT ticker, strftime(window_start_et, '%Y-%m-%d') AS trade_date, "
    f"{r(ratio('sum(close * volume)', 'sum(volume)'))} AS vwap, count(*) AS data_points, "
    f"CAST(sum(volume) AS BIGINT) AS total_volume, {r('min(low)')} AS day_low, {r('max(high)')} AS day_high, "
    f"{r(ratio('(max(high) - min(low))', 'avg(close)'))} AS daily_range_pct "
    f"FROM hours_bars WHERE {_WEEK} GROUP BY 1, 2 ORDER BY 1, 2", "hours_bars"))
def span_vwap(spark, sf_dir):
    return portable(stats.daily_vwap(_span(spark, sf_dir)).orderBy("ticker", "trade_date"))


@query("span_correlation", sql(
    f"SELECT d.ticker, {r(corr('b.daily_close', 'd.daily_close'))} AS correlation, count(*) AS data_points "
    f"FROM closes d JOIN closes b ON d.trade_date = b.trade_date AND b.ticker = '{BASE}' "
    f"WHERE d.ticker <> '{BASE}' GROUP BY 1 ORDER BY 2 DESC", "hours_bars",
    closes="SELECT ticker, CAST(window_start_et AS DATE) AS trade_date, avg(close) AS daily_close "
           f"FROM hours_bars WHERE {_WEEK} GROUP BY 1, 2"))
def span_correlation(spark, sf_dir):
    found = stats.base_correlation(stats.daily_closes(_span(spark, sf_dir)), BASE)
    return portable(found.orderBy(F.desc_nulls_last("correlation")))
