"""Structured Streaming over event messages, landed from events, until the input is drained."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import clock
from barloom.operators.bars import bar_start
from barloom.session import work_dir
from barloom.sources.versions import Versions
from barloom.streaming import bars as streambars
from barloom.streaming import events, manifest, replay, running, sinks
from barloom.workload import query
from barloom.workload.inputs import BAR_LAYOUT, bars, day, moment, once, portable, r, ratio, sql, trades

# Messages are landed by day and streamed in that order, so what comes late is late by minutes.
DELAY = "10 minutes"
DAYS_PER_BATCH = 16


def stream_session(spark):
    """A session of the same application whose state is spread over the cores at hand."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", str(max(spark.sparkContext.defaultParallelism, 4)))
    session.conf.set("spark.sql.session.timeZone", "UTC")
    return session


def messages(spark, sf_dir) -> str:
    """One line per event: an array of a trade message, a quote message, and for some a third."""
    def build(target):
        common = [F.col("ticker").alias("sym"), clock.epoch_ms(F.col("ts")).alias("t"),
                  F.col("sequence").alias("q")]
        trade = F.to_json(F.struct(
            F.lit("T").alias("ev"), *common, F.col("price").alias("p"), F.col("size").alias("s"),
            F.array((F.col("user_id") % 8).cast("int")).alias("c")))
        quote = F.to_json(F.struct(
            F.lit("Q").alias("ev"), *common, F.col("price").alias("bp"), (F.col("price") + 1).alias("ap")))
        other = F.when(F.col("size") < 10, F.lit('{"ev":"status","message":"connected"}')).when(
            F.col("size") >= 90, F.to_json(F.struct(F.lit("ZZ").alias("ev"), F.col("sequence").alias("q"))))
        line = F.concat(F.lit("["), F.concat_ws(",", trade, quote, other), F.lit("]"))
        trades(spark, sf_dir).repartitionByRange("ts", "sequence").select(line.alias("value")).write.text(target)
    return once(spark, sf_dir, "messages", build)


def landed_messages(spark, sf_dir) -> str:
    """The same lines landed by day, and behind them one that only moves the clock by a day."""
    def build(target):
        lines = spark.read.text(messages(spark, sf_dir))
        time = F.get_json_object("value", "$[0].t").cast("bigint")
        landed = lines.withColumn("_t", time).union(
            events.clock_messages(lines, time + 86_400_000).withColumn("_t", F.get_json_object("value", "$.t").cast("bigint")))
        period = F.date_format(F.timestamp_millis("_t").cast("timestamp_ntz"), "yyyy-MM-dd")
        manifest.land_by_time(landed, target, period, ["_t", "value"])
    return once(spark, sf_dir, "landed-messages", build)


def _routed(lines):
    return events.trades_with_time(events.route(events.known_messages(events.parse_messages(lines)), "equity_trade"))


def _trade_stream(spark, sf_dir, files_per_trigger=4):
    return _routed(events.read_message_stream(stream_session(spark), messages(spark, sf_dir), files_per_trigger))


def _timed_trades(spark, sf_dir, target, session=None):
    """Trades in order of their day, with a watermark of minutes."""
    lines = manifest.read_manifest_stream(
        session or stream_session(spark), landed_messages(spark, sf_dir), "value STRING", DAYS_PER_BATCH, f"{target}-progress/at")
    return events.clocked(_routed(lines), DELAY)


_KINDS_SQL = (
    "SELECT 'T' AS ev, 'known' AS fate, count(*) AS n FROM trades UNION ALL SELECT 'Q', 'known', count(*) FROM trades "
    "UNION ALL SELECT 'ZZ', 'quarantined', count(*) FROM trades WHERE size >= 90")


@query("parse_events", sql(_KINDS_SQL, "trades"))
def parse_events(spark, sf_dir):
    """Known and quarantined messages of the stream; status messages are in neither."""
    found = []
    for fate, pick in (("known", events.known_messages), ("quarantined", events.quarantined)):
        target = work_dir(spark, fate)
        lines = events.read_message_stream(stream_session(spark), messages(spark, sf_dir))
        sinks.append_to_table(
            pick(events.parse_messages(lines)), target, f"{target}-checkpoint").awaitTermination()
        found.append(spark.read.schema("ev STRING").parquet(target).withColumn("fate", F.lit(fate)))
    return portable(found[0].unionByName(found[1]).groupBy("ev", "fate").agg(F.count("*").alias("n")))


@query("routed_quotes", sql(
    f"SELECT ticker AS symbol, sequence AS sequence_number, {r('price')} AS bid_price, {r('price + 1')} AS ask_price, "
    "epoch_us(ts) // 1000 AS timestamp FROM trades", "trades"))
def routed_quotes(spark, sf_dir):
    lines = spark.read.text(messages(spark, sf_dir))
    return portable(events.route(events.parse_messages(lines), "equity_quote").select(
        "symbol", "sequence_number", "bid_price", "ask_price", "timestamp"))


@query("subscribed_events", sql(
    "SELECT 'T' AS ev, ticker AS symbol, count(*) AS n FROM trades GROUP BY 2 UNION ALL "
    "SELECT 'Q', ticker, count(*) FROM trades WHERE ticker = 'VIEW' GROUP BY 2", "trades"))
def subscribed_events(spark, sf_dir):
    session, target = stream_session(spark), work_dir(spark, "subscribed")
    subs = events.subscriptions(session, ["T.CLICK", "T.*", "Q.VIEW", "nonsense"])
    lines = events.read_message_stream(session, messages(spark, sf_dir))
    sinks.append_to_table(
        events.subscribed(events.parse_messages(lines), subs), target, f"{target}-checkpoint").awaitTermination()
    return portable(spark.read.parquet(target).groupBy("ev", "symbol").agg(F.count("*").alias("n")))


_STREAM_BARS_SQL = sql(
    f"SELECT ticker AS symbol, {moment('minute')} AS window_start_et, {r('arg_min(price, (t, sequence))')} AS open, "
    f"{r('max(price)')} AS high, {r('min(price)')} AS low, {r('arg_max(price, (t, sequence))')} AS close, "
    "CAST(sum(size) AS BIGINT) AS volume, count(*) AS transactions, "
    f"{r(ratio('sum(price * size)', 'sum(size)'))} AS vwap, {r('avg(size)')} AS average_size FROM ("
    "SELECT *, epoch_us(ts) // 1000 AS t, date_trunc('minute', ts_et) AS minute FROM trades) GROUP BY ticker, minute",
    "trades")


@query("stream_minute_bars", _STREAM_BARS_SQL)
def stream_minute_bars(spark, sf_dir):
    target = work_dir(spark, "streambars")
    made = streambars.stream_bars(_timed_trades(spark, sf_dir, target), delay=None)
    sinks.drain_to_table(made, target, f"{target}-checkpoint")
    return portable(spark.read.parquet(target))


@query("batch_minute_bars", _STREAM_BARS_SQL)
def batch_minute_bars(spark, sf_dir):
    """The same bar definition over the same messages, as a batch."""
    lines = spark.read.text(messages(spark, sf_dir))
    routed = events.route(events.parse_messages(lines), "equity_trade")
    return portable(streambars.stream_bars(events.trades_with_time(routed), delay=None))


@query("stream_dedup", sql(
    f"SELECT ticker AS symbol, sequence AS sequence_number, {r('price')} AS price, size FROM trades", "trades"))
def stream_dedup(spark, sf_dir):
    """Every trade arrives twice and is kept once."""
    target = work_dir(spark, "dedup")
    single = _timed_trades(spark, sf_dir, target)
    twice = single.withColumn("_copy", F.explode(F.array(F.lit(0), F.lit(1)))).drop("_copy")
    sinks.drain_to_table(
        events.drop_repeated(twice, None).select("symbol", "sequence_number", "price", "size"), target, f"{target}-checkpoint")
    return portable(spark.read.parquet(target))


@query("stream_running_vwap", sql(
    "SELECT ticker AS symbol, sequence AS sequence_number, CAST(sum(size) OVER w AS BIGINT) AS accumulated_volume, "
    f"{r(ratio('sum(price * size) OVER w', 'sum(size) OVER w'))} AS aggregate_vwap FROM ("
    "SELECT *, epoch_us(ts) // 1000 AS t FROM trades) "
    "WINDOW w AS (PARTITION BY ticker, CAST(ts_et AS DATE) ORDER BY t, sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    "trades"))
def stream_running_vwap(spark, sf_dir):
    """Volume and VWAP of the day so far for every trade of the stream."""
    target, session = work_dir(spark, "running"), stream_session(spark)
    session.conf.set("spark.sql.streaming.stateStore.providerClass", running.ROCKS)
    totals = running.running_vwap(_timed_trades(spark, sf_dir, target, session))
    sinks.drain_to_table(totals, target, f"{target}-checkpoint")
    return portable(spark.read.parquet(target).select("symbol", "sequence_number", "accumulated_volume", "aggregate_vwap"))


@query("stream_late_trades", sql(
    "SELECT ticker AS symbol, sequence AS sequence_number FROM trades t WHERE size >= 95 AND EXISTS ("
    "SELECT 1 FROM trades o WHERE epoch_us(o.ts) // 1000 - 600000 >= epoch_us(t.ts) // 1000)", "trades"))
def stream_late_trades(spark, sf_dir):
    """Large trades arrive again after the last day; those more than the delay behind the latest trade go to the side table."""
    target = work_dir(spark, "late")

    def build(path):
        lines = spark.read.text(messages(spark, sf_dir)).withColumn("_t", F.get_json_object("value", "$[0].t").cast("bigint"))
        day_of = F.date_format(F.timestamp_millis("_t").cast("timestamp_ntz"), "yyyy-MM-dd")
        manifest.land_by_time(lines, path, day_of, ["_t", "value"])
        again = lines.where(F.get_json_object("value", "$[0].s").cast("bigint") >= 95)
        manifest.land_by_time(again, path, F.lit("again"), ["_t", "value"])

    landed = once(spark, sf_dir, "landed-again", build)
    days = Versions(spark, landed).entries(columns=manifest.MANIFEST).where("period <> 'again'").select("period").distinct().count()
    lines = manifest.read_manifest_stream(stream_session(spark), landed, "value STRING", days, f"{target}-progress/at")
    sinks.late_rows(_routed(lines), "event_time", DELAY, target, f"{target}-checkpoint")
    return portable(spark.read.parquet(f"{target}/late").select("symbol", "sequence_number"))


@query("stream_day_vwap", sql(
    f"SELECT ticker AS symbol, {day('CAST(ts_et AS DATE)')} AS trade_date, "
    f"CAST(sum(size) AS BIGINT) AS accumulated_volume, {r(ratio('sum(price * size)', 'sum(size)'))} AS aggregate_vwap, "
    "count(*) AS transactions FROM trades GROUP BY 1, 2", "trades"))
def stream_day_vwap(spark, sf_dir):
    target = work_dir(spark, "daytotals")
    totals = streambars.stream_day_totals(_timed_trades(spark, sf_dir, target), None)
    sinks.drain_versions(totals, target, f"{target}-checkpoint")
    return portable(sinks.read_latest(spark, target, ["symbol", "trade_date"]))


@query("stream_callback", sql("SELECT ticker AS symbol, count(*) AS n FROM trades GROUP BY 1", "trades"))
def stream_callback(spark, sf_dir):
    """A user callback that stores counts per batch."""
    target = work_dir(spark, "callback")

    def handle(batch, batch_id):
        batch.groupBy("symbol").count().write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    sinks.run_callback(_trade_stream(spark, sf_dir, 2), handle, f"{target}-checkpoint").awaitTermination()
    return portable(spark.read.parquet(target).groupBy("symbol").agg(F.sum("count").alias("n")))


@query("replay_bars", sql(
    f"SELECT ticker, {moment('window_start_et')} AS window_start_et, {r('close')} AS close, "
    "true AS in_order FROM bars", "bars"))
def replay_bars(spark, sf_dir):
    """Bars replayed week by week: a batch is one week, and no bar comes before one of an earlier batch."""
    target = work_dir(spark, "replay")
    replay.stage_replay(bars(spark, sf_dir), f"{target}/staged", "week")
    stream = replay.replay_stream(stream_session(spark), f"{target}/staged", BAR_LAYOUT, 1, f"{target}/progress/at")
    sinks.drain_versions(stream, f"{target}/out", f"{target}/checkpoint")
    out = spark.read.parquet(f"{target}/out")
    week = bar_start(F.col("window_start_et"), 1, "week")
    spans = out.groupBy("batch_id").agg(
        F.min("window_start_et").alias("_first"), F.max("window_start_et").alias("_last"), F.count_distinct(week).alias("_weeks"))
    before = F.max("_last").over(W.orderBy("batch_id").rowsBetween(W.unboundedPreceding, -1))
    spans = spans.select("batch_id", (F.coalesce(before < F.col("_first"), F.lit(True)) & (F.col("_weeks") == 1)).alias("in_order"))
    return portable(out.join(F.broadcast(spans), "batch_id").select(
        "ticker", "window_start_et", "close", "in_order"))
