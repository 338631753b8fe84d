"""Market tables derived from the given tables, in Spark and as SQL text.

Events stand in for trades: the ticker is the event type (or the user, for a
wide set of tickers), the price is the value and the size is ``k`` of ``props``.
Event times are UTC and lie in winter, so market time is five hours behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import clock
from barloom.operators.bars import bars_from_trades
from barloom.session import work_dir

# Added before rounding on both sides: means of prices often end in exactly half a
# unit of the sixth digit, where the last bit of the sum would decide.
NUDGE = 1e-9

BASE = "VIEW"
TICKERS = ["CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW"]


# Declared layouts spare a footer read per query.
LAYOUTS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, "
                "l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, "
                "l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "labels": "doc_id BIGINT, quality INT, toxic INT",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read.schema(LAYOUTS[name]) if name in LAYOUTS else spark.read
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def trades(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    ticker = F.concat(F.lit("U"), F.col("user_id")) if wide else F.upper("event_type")
    return table(spark, sf_dir, "events").select(
        ticker.alias("ticker"), "ts", clock.to_market(F.col("ts")).alias("ts_et"),
        F.col("value").alias("price"), F.regexp_extract("props", r'"k": *(\d+)', 1).cast("bigint").alias("size"),
        F.col("event_id").alias("sequence"), "user_id")


def bars(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    return bars_from_trades(trades(spark, sf_dir, wide)).drop("average_size")


BAR_LAYOUT = ("ticker STRING, window_start_et TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, "
              "volume BIGINT, transactions BIGINT, vwap DOUBLE")

# Tables built in this session, by application, input folder and label.
_BUILT: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, sf_dir: str, label: str, build) -> str:
    """Folder of a derived table, written on its first use in the session."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _BUILT:
        target = work_dir(spark, label)
        build(target)
        _BUILT[key] = target
    return _BUILT[key]


def stored_bars(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """All minute bars as a stored table, the form in which analytics meet them."""
    target = once(spark, sf_dir, f"bars-{wide}", lambda path: bars(spark, sf_dir, wide).write.parquet(path))
    return spark.read.schema(BAR_LAYOUT).parquet(target)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades(spark, sf_dir).select(
        "ticker", "ts", "sequence", (F.col("price") - 0.05).alias("bid_price"),
        (F.col("price") + 0.05).alias("ask_price"), F.col("size").alias("bid_size"),
        (F.col("size") + 1).alias("ask_size"))


def portable(df: DataFrame) -> DataFrame:
    """Plain column types: text dates and times, 64-bit whole numbers, doubles of six digits."""
    out = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.TimestampNTZType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(column.cast("double") + NUDGE, 6) + F.lit(0.0)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        out.append(column.alias(field.name))
    return df.select(*out)


def _trades_sql(ticker: str) -> str:
    return (
        f"SELECT {ticker} AS ticker, ts, ts - INTERVAL 5 HOUR AS ts_et, value AS price, "
        "CAST(json_extract_string(props, '$.k') AS BIGINT) AS size, event_id AS sequence, user_id FROM events")


def _bars_sql(source: str) -> str:
    return (
        "SELECT ticker, date_trunc('minute', ts_et) AS window_start_et, "
        "arg_min(price, (ts, sequence)) AS open, max(price) AS high, min(price) AS low, "
        "arg_max(price, (ts, sequence)) AS close, CAST(sum(size) AS BIGINT) AS volume, "
        "count(*) AS transactions, CASE WHEN sum(size) <> 0 THEN sum(price * size) / sum(size) END AS vwap "
        f"FROM {source} GROUP BY 1, 2")


CTES = {
    "trades": _trades_sql("upper(event_type)"),
    "wide_trades": _trades_sql("'U' || user_id"),
    "bars": _bars_sql("trades"),
    "wide_bars": _bars_sql("wide_trades"),
    "hours_bars": (
        "SELECT *, CAST(year(window_start_et) AS BIGINT) AS year FROM bars "
        "WHERE hour(window_start_et) * 60 + minute(window_start_et) BETWEEN 570 AND 959 "
        "AND isodow(window_start_et) <= 5"),
    "quotes": (
        "SELECT ticker, ts, sequence, price - 0.05 AS bid_price, price + 0.05 AS ask_price, "
        "size AS bid_size, size + 1 AS ask_size FROM trades"),
    "daily": (
        "SELECT ticker, CAST(window_start_et AS DATE) AS trade_date, avg(close) AS daily_close "
        "FROM bars GROUP BY 1, 2"),
    "day_bars": (
        "SELECT ticker, CAST(window_start_et AS DATE) AS trade_date, arg_min(open, window_start_et) AS open, "
        "max(high) AS high, min(low) AS low, arg_max(close, window_start_et) AS close, "
        "CAST(sum(volume) AS BIGINT) AS volume, "
        "CASE WHEN sum(volume) <> 0 THEN sum(vwap * volume) / sum(volume) END AS vwap, "
        "CAST(sum(transactions) AS BIGINT) AS transactions FROM bars GROUP BY 1, 2"),
}
_NEEDS = {
    "bars": ["trades"], "wide_bars": ["wide_trades"], "quotes": ["trades"], "daily": ["bars"],
    "day_bars": ["bars"], "hours_bars": ["bars"],
}


def sql(body: str, *ctes: str, recursive: bool = False, **extra: str) -> str:
    """``body`` preceded by the named tables, those they need, and ``extra`` ones."""
    names: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in names:
            names.append(name)

    for name in ctes:
        need(name)
    parts = [f"{n} AS ({CTES[n]})" for n in names] + [f"{n} AS ({text})" for n, text in extra.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)} {body}" if parts else body


def r(text: str) -> str:
    """Six digits, and no negative zero."""
    return f"round(CAST({text} AS DOUBLE) + {NUDGE:.9f}, 6) + 0.0"


def day(text: str) -> str:
    return f"strftime({text}, '%Y-%m-%d')"


def moment(text: str) -> str:
    return f"strftime({text}, '%Y-%m-%d %H:%M:%S')"


def ratio(top: str, bottom: str) -> str:
    return f"CASE WHEN {bottom} <> 0 THEN {top} / {bottom} END"


def corr(x: str, y: str) -> str:
    """Correlation, NULL where it is undefined."""
    return f"CASE WHEN isfinite(corr({x}, {y})) THEN corr({x}, {y}) END"
