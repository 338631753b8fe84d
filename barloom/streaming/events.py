"""Event messages: parsing, routing by type, subscriptions and duplicates.

Every function takes batch and streaming frames alike.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import schemas
from barloom.errors import DataValidationError
from barloom.functions import clock
from barloom.session import broadcast_if_counted, settled

log = logging.getLogger(__name__)


def read_message_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of landed text files; each line is a JSON array of messages or one message."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def parse_messages(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row per message: its type ``ev``, its symbol and its JSON text."""
    text = F.when(F.startswith(F.trim(column), F.lit("[")), F.col(column)).otherwise(
        F.concat(F.lit("["), F.col(column), F.lit("]")))
    messages = lines.select(F.explode(F.from_json(text, "ARRAY<STRING>")).alias("message"))
    # One parse for the routing fields; keys are case sensitive (t is time, T a symbol).
    head = F.from_json("message", "MAP<STRING, STRING>")
    keyed = messages.withColumn("_m", head).withColumn("ev", F.col("_m").getItem("ev"))
    symbol = F.coalesce(
        F.col("_m").getItem("sym"), F.col("_m").getItem("pair"), F.col("_m").getItem("T"),
        F.when(F.col("ev") == "C", F.col("_m").getItem("p")))
    return keyed.select("ev", symbol.alias("symbol"), "message")


def known_messages(messages: DataFrame) -> DataFrame:
    """Messages of a known type; status messages are left out."""
    return messages.filter(F.col("ev").isin(list(schemas.EVENT_TYPES)))


def quarantined(messages: DataFrame) -> DataFrame:
    """Messages of no known type, except status messages."""
    known = [*schemas.EVENT_TYPES, schemas.STATUS_EVENT]
    return messages.filter(F.col("ev").isNull() | ~F.col("ev").isin(known))


def route(messages: DataFrame, kind: str) -> DataFrame:
    """Typed columns of all messages of one kind, such as ``equity_trade``."""
    tags = [tag for tag, (name, _) in schemas.EVENT_TYPES.items() if name == kind]
    if not tags:
        raise DataValidationError(f"unknown message kind {kind!r}")
    fields = schemas.EVENT_TYPES[tags[0]][1]
    raw = F.from_json("message", "MAP<STRING, STRING>")
    picked = messages.filter(F.col("ev").isin(tags)).withColumn("_m", raw)
    typed = []
    for short, (name, kind_of) in fields.items():
        value = F.col("_m").getItem(short)
        typed.append((F.from_json(value, kind_of) if kind_of.startswith("ARRAY")
                      else value.try_cast(kind_of)).alias(name))
    return picked.select(F.col("ev").alias("event_type"), *typed)


def subscriptions(spark: SparkSession, wanted: list[str]) -> DataFrame:
    """``topic, sym`` of subscriptions ``topic.symbol``; ``*`` stands for all symbols."""
    rows = []
    for text in wanted:
        topic, dot, sym = text.strip().partition(".")
        if not dot:
            log.warning("invalid subscription: %s", text)
            continue
        rows.append((topic, sym))
    all_of = {topic for topic, sym in rows if sym == "*"}
    kept = sorted({(t, s) for t, s in rows if s == "*" or t not in all_of})
    return spark.createDataFrame(kept, "topic STRING, sym STRING")


def subscribed(messages: DataFrame, subs: DataFrame) -> DataFrame:
    """Messages that any subscription asks for.

    Topics with a wildcard are a condition on the type alone, as many as there
    are types. Exact (topic, symbol) pairs are an equi-join: broadcast if their
    counted size allows, else shuffled by both.
    """
    of_all = [r.topic for r in subs.where("sym = '*'").select("topic").distinct().collect()]
    exact = settled(subs.where("sym <> '*'").select(F.col("topic").alias("_topic"), F.col("sym").alias("_sym")).where(
        ~F.col("topic").isin(of_all)).distinct(), "subscriptions")
    whole = F.coalesce(F.col("ev").isin(of_all), F.lit(False))
    if exact.isEmpty():
        return messages.where(whole)
    keyed = messages.where(whole | F.col("symbol").isNotNull())
    picked = keyed.join(broadcast_if_counted(exact).withColumn("_asked", F.lit(True)), (F.col("ev") == F.col("_topic")) & (F.col("symbol") == F.col("_sym")), "left")
    return picked.where(whole | F.col("_asked")).drop("_topic", "_sym", "_asked")


def trades_with_time(trades: DataFrame) -> DataFrame:
    """Routed trades with an event time usable for watermarks (``TIMESTAMP``, UTC instant)."""
    return trades.withColumn("event_time", F.timestamp_millis("timestamp"))


def clock_messages(lines: DataFrame, time_ms: Column, column: str = "value") -> DataFrame:
    """One line more than ``lines``: a trade without symbol at the largest ``time_ms``. It moves the clock and nothing else."""
    last = lines.agg(F.max(time_ms).alias("t"))
    return last.where("t IS NOT NULL").select(F.to_json(F.struct(F.lit("T").alias("ev"), "t")).alias(column))


def clocked(trades: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Timed trades with a watermark; trades without symbol have moved it and go."""
    # One condition that names the time as well, so that no part of it is moved below the watermark.
    return trades.withWatermark("event_time", delay).where(F.col("symbol").isNotNull() | F.col("event_time").isNull())


def drop_repeated(trades: DataFrame, delay: str | None = "10 minutes",
                  keys: tuple[str, ...] = ("symbol", "sequence_number")) -> DataFrame:
    """Each (symbol, sequence) once, for repeats that arrive within the watermark delay. Pass None if the input already carries a watermark."""
    timed = trades.withWatermark("event_time", delay) if delay else trades
    return timed.dropDuplicatesWithinWatermark(list(keys))


def market_time(column: str):
    """Market wall clock of a ``TIMESTAMP`` instant, whatever the session zone."""
    return clock.to_market(clock.utc_from_epoch(F.unix_micros(column), "us"))
