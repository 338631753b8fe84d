"""Streams against their batch meaning, on landed message files."""

import json

import pytest
from pyspark.sql import functions as F

from barloom.errors import ConfigurationError, DataValidationError
from barloom.streaming import bars as streambars
from barloom.sources.versions import Versions
from barloom.streaming import events, manifest, replay, running, sinks


def trade(sym, t, p, s, q, **more):
    return {"ev": "T", "sym": sym, "t": t, "p": p, "s": s, "q": q, **more}


def land(folder, name, *lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(line) for line in lines) + "\n")


def trades_of(spark, folder, per_trigger=None):
    lines = events.read_message_stream(spark, str(folder), per_trigger)
    return events.trades_with_time(events.route(events.parse_messages(lines), "equity_trade"))


def test_parsing_and_routing(spark):
    lines = spark.createDataFrame([
        (json.dumps([trade("A", 1, 2.5, 3, 4, c=[1, 2]), {"ev": "status"}, {"ev": "??"}]),),
        (json.dumps({"ev": "C", "p": "EUR/USD", "a": 1.1, "b": 1.0, "t": 9}),),
        (json.dumps([{"ev": "V", "T": "I:X", "val": 3, "t": 7}, {"ev": "AM", "sym": "A", "o": 1, "c": 2, "s": 5}]),),
        (json.dumps([{"ev": "XL2", "pair": "B-U", "b": [[1, 2]], "a": [[3, 4]], "t": 8}]),),
    ], "value STRING")
    messages = events.parse_messages(lines)
    assert {(r.ev, r.symbol) for r in messages.collect()} == {
        ("T", "A"), ("status", None), ("??", None), ("C", "EUR/USD"), ("V", "I:X"), ("AM", "A"), ("XL2", "B-U")}
    assert {r.ev for r in events.quarantined(messages).collect()} == {"??"}
    assert events.known_messages(messages).count() == 5
    row = events.route(messages, "equity_trade").first()
    assert (row.symbol, row.price, row.size, row.conditions, row.timestamp) == ("A", 2.5, 3, [1, 2], 1)
    assert events.route(messages, "index_value").first().ticker == "I:X"
    assert events.route(messages, "crypto_book").first().bid_prices == [[1.0, 2.0]]
    bar = events.route(messages, "equity_bar").first()
    assert (bar.open, bar.close, bar.start_timestamp, bar.vwap) == (1.0, 2.0, 5, None)
    with pytest.raises(DataValidationError):
        events.route(messages, "poetry")


def test_subscriptions(spark):
    subs = events.subscriptions(spark, ["T.A", "T.*", " Q.B ", "broken"])
    assert {tuple(r) for r in subs.collect()} == {("T", "*"), ("Q", "B")}
    messages = spark.createDataFrame(
        [("T", "A"), ("T", None), ("Q", "A"), ("Q", "B"), ("C", "B")], "ev STRING, symbol STRING")
    assert {tuple(r) for r in events.subscribed(messages, subs).collect()} == {("T", "A"), ("T", None), ("Q", "B")}


def test_late_trades_are_dropped_after_the_watermark(spark, tmp_path):
    minute = 60_000
    land(tmp_path / "in", "a.txt", [trade("A", 10 * minute, 1.0, 1, 1)], [trade("A", 10 * minute + 5, 3.0, 2, 2)])
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        made = streambars.stream_bars(trades_of(spark, tmp_path / "in"))
        query = sinks.append_to_table(made, out, check)
        query.awaitTermination()
        return query

    run()
    land(tmp_path / "in", "b.txt", [trade("A", 20 * minute, 9.0, 1, 3)])
    run()
    land(tmp_path / "in", "c.txt", [trade("A", 10 * minute, 99.0, 1, 4), trade("A", 30 * minute, 7.0, 1, 5)])
    query = run()
    dropped = sum(int(op["numRowsDroppedByWatermark"]) for p in query.recentProgress for op in p["stateOperators"])
    rows = {str(r.window_start_et)[11:16]: r for r in spark.read.parquet(out).collect()}
    assert dropped == 1
    assert (rows["19:10"].open, rows["19:10"].close, rows["19:10"].volume) == (1.0, 3.0, 3)
    assert "19:20" in rows and len(rows) == 2


def test_repeats_are_dropped_across_restarts(spark, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for name in ("a.txt", "b.txt"):
        land(tmp_path / "in", name, [trade("A", 1000, 1.0, 1, 1), trade("B", 1000, 1.0, 1, 1)])
        sinks.append_to_table(
            events.drop_repeated(trades_of(spark, tmp_path / "in")), out, check).awaitTermination()
    assert spark.read.parquet(out).count() == 2


def test_upsert_keeps_the_last_version(spark, tmp_path):
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for i in range(3):
        land(tmp_path / "in", f"{i}.txt", [trade("A", 1_704_295_800_000 + i, 10.0 + i, 1, i)])
        totals = streambars.stream_day_totals(trades_of(spark, tmp_path / "in"))
        sinks.upsert_versions(totals, out, check).awaitTermination()
    row = sinks.read_latest(spark, out, ["symbol", "trade_date"]).collect()
    assert [(r.symbol, str(r.trade_date), r.accumulated_volume, r.aggregate_vwap) for r in row] == [
        ("A", "2024-01-03", 3, 11.0)]


def test_market_day_does_not_depend_on_the_session_zone(spark):
    trades = spark.createDataFrame([("A", 1_704_254_400_000, 1.0, 1)], "symbol STRING, timestamp BIGINT, price DOUBLE, size BIGINT")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        row = streambars.stream_day_totals(events.trades_with_time(trades), None).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert str(row.trade_date) == "2024-01-02"


def _days(spark, *days):
    return spark.createDataFrame(
        [(t, d and f"2024-01-0{d} 10:00:00", float(d or 0)) for d in days for t in ("B", "A")],
        "ticker STRING, t STRING, close DOUBLE").select("ticker", F.col("t").cast("timestamp_ntz").alias("window_start_et"), "close")


REPLAYED = "ticker STRING, window_start_et TIMESTAMP_NTZ, close DOUBLE"


def _run(stream, folder, seen):
    """Drain a stream into a list of its batches."""
    handle = lambda batch, _: seen.append([(r.close, r.ticker) for r in batch.collect()])
    sinks.drained(stream.writeStream.option("checkpointLocation", str(folder)).foreachBatch(handle))


def test_replay_in_time_order(spark, tmp_path):
    bars = _days(spark, 3, None, 2, 4)
    assert [(r.close, r.ticker) for r in replay.next_bars(bars)][2:] == [
        (2.0, "A"), (2.0, "B"), (3.0, "A"), (3.0, "B"), (4.0, "A"), (4.0, "B")]
    staged, seen = str(tmp_path / "staged"), []
    assert replay.stage_replay(bars.coalesce(1), staged) == 4
    _run(replay.replay_stream(spark, staged, REPLAYED, progress=str(tmp_path / "at")), tmp_path / "check", seen)
    # Bars without a time are the first period.
    assert [sorted(b) for b in seen if b] == [[(float(d), "A"), (float(d), "B")] for d in (0, 2, 3, 4)]


def test_a_restarted_replay_goes_on_where_it_stopped(spark, tmp_path):
    staged, seen = str(tmp_path / "staged"), []
    replay.stage_replay(_days(spark, 2, 3), staged)

    def run():
        _run(replay.replay_stream(spark, staged, REPLAYED, progress=str(tmp_path / "at")), tmp_path / "check", seen)

    run()
    run()
    # Periods landed later follow, also an older one.
    assert replay.stage_replay(_days(spark, 5, 1), staged) == 2
    run()
    assert [b[0][0] for b in seen if b] == [2.0, 3.0, 1.0, 5.0]


def test_a_large_period_is_several_ordered_files(spark, tmp_path):
    staged = str(tmp_path / "staged")
    bars = spark.range(20_000).select(F.lit("A").alias("ticker"), F.expr(
        "CAST(timestamp_seconds(1704100000 + (id * 7919) % 20000) AS TIMESTAMP_NTZ)").alias("window_start_et"), F.col("id").cast("double").alias("close"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert replay.stage_replay(bars, staged) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = Versions(spark, staged).entries(columns=manifest.MANIFEST).orderBy("position").collect()
    spans = [spark.read.parquet(f"{staged}/{f.path}").agg(F.min("window_start_et"), F.max("window_start_et")).first() for f in files]
    assert len(files) == 4 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


MINUTE = 60_000
START = 1_704_295_800_000


def _land(spark, path, period, rows):
    """Trades (symbol, minute, price, size, sequence) as the next period; a null symbol moves the clock."""
    lines = spark.createDataFrame([(json.dumps({k: v for k, v in trade(s, START + m * MINUTE, p, n, q).items() if v is not None}), START + m * MINUTE)
                                   for s, m, p, n, q in rows], "value STRING, _t BIGINT")
    manifest.land_by_time(lines, str(path), F.lit(period), ["_t", "value"])


def _clocked(spark, tmp_path, name):
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "2")
    session.conf.set("spark.sql.streaming.stateStore.providerClass", running.ROCKS)
    lines = manifest.read_manifest_stream(session, str(tmp_path / "in"), "value STRING", 1, str(tmp_path / f"{name}-at"))
    return events.trades_with_time(events.route(events.parse_messages(lines), "equity_trade"))


def test_running_totals_per_trade(spark, tmp_path):
    """Out of order within the delay, over batches, with nulls, a late trade and a second day."""
    day = 24 * 60
    _land(spark, tmp_path / "in", "1", [("A", 5, 10.0, 1, 2), ("A", 3, 20.0, 1, 1), ("B", 4, 5.0, 2, 9)])
    _land(spark, tmp_path / "in", "2", [("A", 4, 30.0, 2, 3), ("A", 7, None, 4, 4), ("A", 7, 8.0, None, 5), ("A", 40, 1.0, 4, 6)])
    _land(spark, tmp_path / "in", "3", [("A", 6, 99.0, 9, 7), ("A", 41, 1.0, 0, 8), ("A", day, 2.0, 3, 10)])
    _land(spark, tmp_path / "in", "4", [(None, 4 * day, None, None, None)])
    out = str(tmp_path / "out")
    query = sinks.drain_to_table(running.running_vwap(events.clocked(_clocked(spark, tmp_path, "run"))), out, str(tmp_path / "check"))
    rows = spark.read.parquet(out).collect()
    found = sorted((r.symbol, str(r.trade_date), r.timestamp, r.sequence_number, r.accumulated_volume, round(r.aggregate_vwap, 6)) for r in rows)
    assert [(f[0], f[3], f[4], f[5]) for f in found] == [
        ("A", 1, 1, 20.0), ("A", 3, 3, 26.666667), ("A", 2, 4, 22.5), ("A", 4, 8, 11.25), ("A", 5, 8, 11.25), ("A", 6, 12, 7.833333), ("A", 8, 12, 7.833333),
        ("A", 10, 3, 2.0), ("B", 9, 2, 5.0)]
    assert sinks.state_rows(query)


def test_late_trades_have_a_table_of_their_own(spark, tmp_path):
    _land(spark, tmp_path / "in", "1", [("A", 0, 1.0, 1, 1), ("A", 30, 1.0, 1, 2)])
    _land(spark, tmp_path / "in", "2", [("A", 20, 1.0, 1, 3), ("A", 21, 1.0, 1, 4), ("A", 5, 1.0, 1, 5), ("A", 60, 1.0, 1, 6)])
    _land(spark, tmp_path / "in", "3", [("A", 45, 1.0, 1, 7), ("A", 55, 1.0, 1, 8)])
    out = str(tmp_path / "late")
    sinks.late_rows(_clocked(spark, tmp_path, "late"), "event_time", "10 minutes", out, str(tmp_path / "check"))
    assert sorted(r.sequence_number for r in spark.read.parquet(f"{out}/late").collect()) == [3, 5, 7]
    # The same trades are what running totals with this delay leave out.
    _land(spark, tmp_path / "in", "4", [(None, 24 * 60, None, None, None)])
    kept = running.running_vwap(events.clocked(_clocked(spark, tmp_path, "kept")))
    sinks.drain_to_table(kept, str(tmp_path / "kept"), str(tmp_path / "check2"))
    assert sorted(r.sequence_number for r in spark.read.parquet(str(tmp_path / "kept")).collect()) == [1, 2, 4, 6, 8]


def test_state_is_released_as_time_goes_on(spark, tmp_path):
    for d in range(5):
        _land(spark, tmp_path / "in", str(d), [("A", d * 100 + m, 1.0, 1, d * 100 + m) for m in range(100)])
    made = streambars.stream_bars(events.clocked(_clocked(spark, tmp_path, "bars"), "3 minutes"), delay=None)
    query = sinks.drain_to_table(made, str(tmp_path / "out"), str(tmp_path / "check"))
    held = [r["rows"] for r in sinks.state_rows(query)]
    # Each batch holds its own windows and hands over the last few only.
    assert max(held) <= 110 and held[-1] <= 10
    assert spark.read.parquet(str(tmp_path / "out")).count() == 500 - held[-1]


def test_subscriptions_without_a_wildcard(spark):
    messages = spark.createDataFrame([("T", "A"), ("T", None), ("Q", "B"), (None, "A"), (None, None)], "ev STRING, symbol STRING")
    exact = events.subscriptions(spark, ["T.A", "Q.C"])
    assert [tuple(r) for r in events.subscribed(messages, exact).collect()] == [("T", "A")]
    assert events.subscribed(messages, events.subscriptions(spark, ["Q.*"])).count() == 1


def test_running_totals_need_a_store_that_can_hold_lists(spark):
    trades = spark.createDataFrame([("A", 1, 1, 1.0, 1)], "symbol STRING, timestamp BIGINT, sequence_number BIGINT, price DOUBLE, size BIGINT")
    with pytest.raises(ConfigurationError):
        running.running_vwap(events.trades_with_time(trades))
