"""Bars, day-over-day, adjustment, reference data and set operators on small hand-made tables."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import schemas
from barloom.errors import ConfigurationError, DataValidationError
from barloom.operators import adjust, bars as barops, daily, refdata, rows, stats
from barloom.session import broadcast_if_counted, build_session, counted_bytes, settled, steering, work_dir
from barloom.sources import landed
from barloom.sources.barstore import map_chunks


def bars_of(spark, data, columns="ticker STRING, t STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, "
                                 "volume BIGINT, transactions BIGINT"):
    return spark.createDataFrame(data, columns).withColumn(
        "window_start_et", F.col("t").cast("timestamp_ntz")).drop("t")


def bar(ticker, t, price, volume=10):
    return (ticker, t, float(price), price + 1.0, price - 1.0, float(price), volume, 1)


def test_gap_filling_matches_pandas_resample(spark):
    data = [bar("A", f"2024-01-03 {h:02d}:{m:02d}:00", 10 + m) for h, m in
            ((9, 31), (9, 33), (9, 36), (9, 57), (10, 1))] + [bar("B", "2024-01-03 10:00:00", 5)]
    found = barops.resample(bars_of(spark, data), fill_gaps=True).toPandas()
    frame = pd.DataFrame(data, columns=["ticker", "t", "open", "high", "low", "close", "volume", "transactions"])
    frame["t"] = pd.to_datetime(frame["t"])
    want = frame.set_index("t").groupby("ticker").resample("5min").agg(
        {"open": "first", "high": "max", "low": "min", "close": "last", "volume": "sum", "transactions": "sum"})
    got = found.rename(columns={"bar_start": "t"}).set_index(["ticker", "t"]).sort_index()
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False, check_index_type=False)


def test_session_only_grid_skips_nights_and_weekends(spark):
    data = [bar("A", "2024-01-05 15:50:00", 1), bar("A", "2024-01-08 09:32:00", 2)]
    found = barops.resample(bars_of(spark, data), fill_gaps=True, session_only=True)
    assert sorted(str(r.bar_start) for r in found.collect()) == [
        "2024-01-05 15:50:00", "2024-01-05 15:55:00", "2024-01-08 09:30:00"]


@pytest.mark.parametrize("n, span, start", [
    (1, "day", "2024-05-16"), (7, "day", "2024-05-16"), (1, "week", "2024-05-13"), (2, "week", "2024-05-13"),
    (1, "month", "2024-05-01"), (5, "month", "2024-03-01"), (1, "quarter", "2024-04-01"),
    (2, "quarter", "2024-01-01"), (1, "year", "2024-01-01"), (10, "year", "2020-01-01"),
    (30, "second", "2024-05-16 13:47:30"), (15, "minute", "2024-05-16 13:45:00"), (4, "hour", "2024-05-16 12:00:00")])
def test_bar_starts(spark, n, span, start):
    row = spark.sql("SELECT timestamp_ntz'2024-05-16 13:47:31.5' AS t").select(
        barops.bar_start(F.col("t"), n, span).alias("s")).first()
    assert str(row.s) == (start if " " in start else start + " 00:00:00")


def test_unknown_timespan(spark):
    with pytest.raises(DataValidationError):
        barops.bar_start(F.col("t"), 1, "fortnight")
    with pytest.raises(DataValidationError):
        barops.bar_start(F.col("t"), 0, "day")


def test_bars_from_trades_across_the_clock_change(spark):
    trades = spark.createDataFrame([
        ("A", "2024-11-03 05:30:10", 1.0, 5, 2), ("A", "2024-11-03 05:30:10", 2.0, 5, 1),
        ("A", "2024-11-03 06:30:20", 3.0, 0, 3)],
        "ticker STRING, t STRING, price DOUBLE, size BIGINT, sequence BIGINT").withColumn(
        "ts", F.col("t").cast("timestamp_ntz"))
    # Both UTC minutes show 01:30 on the wall; they stay two bars, and hours are cut in market time.
    minute = barops.bars_from_trades(trades).orderBy("open").collect()
    assert [(str(r.window_start_et), r.open, r.close, r.vwap) for r in minute] == [
        ("2024-11-03 01:30:00", 2.0, 1.0, 1.5), ("2024-11-03 01:30:00", 3.0, 3.0, None)]
    day = barops.bars_from_trades(trades, 1, "day").first()
    assert (str(day.window_start_et), day.volume, day.transactions) == ("2024-11-03 00:00:00", 10, 3)


def test_zero_volume_gives_null_vwap(spark):
    row = stats.daily_vwap(bars_of(spark, [bar("A", "2024-01-03 10:00:00", 5, 0)])).first()
    assert row.vwap is None and row.total_volume == 0


def test_top_movers(spark):
    frame = spark.createDataFrame(
        [("A", "2024-01-02", 10.0), ("A", "2024-01-03", 11.0), ("B", "2024-01-02", 10.0), ("B", "2024-01-03", 12.0),
         ("C", "2024-01-03", 99.0), ("D", "2024-01-02", 0.0), ("D", "2024-01-03", 5.0), ("E", "2024-01-01", 10.0),
         ("E", "2024-01-03", 9.0), ("B", "2024-01-04", 1.0)],
        "ticker STRING, d STRING, close DOUBLE").withColumn("trade_date", F.to_date("d"))
    assert [r.ticker for r in daily.top_movers(frame, "2024-01-03", "gainers", 2).collect()] == ["B", "A"]
    assert [r.ticker for r in daily.top_movers(frame, "2024-01-03", "losers").collect()] == ["E", "A", "B"]
    otc = frame.withColumn("otc", F.col("ticker") == "B")
    assert [r.ticker for r in daily.top_movers(otc, "2024-01-03", n=1).collect()] == ["A"]
    with pytest.raises(DataValidationError):
        daily.top_movers(frame, "2024-01-03", "sideways")


def test_split_adjustment(spark):
    splits = spark.createDataFrame(
        [("A", "2024-01-10", 1.0, 2.0), ("A", "2024-01-20", 1.0, 5.0), ("A", "2024-01-20", 2.0, 1.0)],
        "ticker STRING, d STRING, split_from DOUBLE, split_to DOUBLE").withColumn("execution_date", F.to_date("d"))
    data = [bar("A", f"2024-01-{d} 10:00:00", 100) for d in ("09", "10", "19", "20")] + [
        bar("B", "2024-01-01 10:00:00", 7)]
    found = {(r.ticker, r.window_start_et.day): (round(r.close, 9), round(r.volume, 9))
             for r in adjust.split_adjusted(bars_of(spark, data), splits).collect()}
    assert found == {("A", 9): (20.0, 50.0), ("A", 10): (40.0, 25.0), ("A", 19): (40.0, 25.0),
                     ("A", 20): (100.0, 10.0), ("B", 1): (7.0, 10.0)}


def test_renames(spark):
    renames = spark.createDataFrame(
        [(1, "2020-01-01", "OLD"), (1, "2024-01-05", "NEW"), (2, "2024-01-05", "OLD")],
        "instrument INT, d STRING, ticker STRING").withColumn("date", F.to_date("d"))
    data = [bar("OLD", "2024-01-04 10:00:00", 1), bar("OLD", "2024-01-05 10:00:00", 2),
            bar("NEW", "2024-01-05 10:00:00", 3), bar("X", "2024-01-05 10:00:00", 4)]
    found = {r.close: r.current_ticker for r in adjust.current_symbols(bars_of(spark, data), renames).collect()}
    assert found == {1.0: "NEW", 2.0: "OLD", 3.0: "NEW", 4.0: "X"}


def test_trading_calendar(spark):
    holidays = spark.createDataFrame(
        [("NYSE", "2024-01-15", "closed", None), ("NYSE", "2024-01-16", "early-close", "13:00"),
         ("OTC", "2024-01-17", "closed", None)],
        "exchange STRING, d STRING, status STRING, close STRING").withColumn("date", F.to_date("d"))
    data = [bar("A", t, i) for i, t in enumerate((
        "2024-01-15 10:00:00", "2024-01-16 12:59:00", "2024-01-16 13:00:00", "2024-01-17 15:00:00"))]
    kept = adjust.on_trading_calendar(bars_of(spark, data), holidays, "NYSE")
    assert sorted(r.open for r in kept.collect()) == [1.0, 3.0]
    assert kept.columns == bars_of(spark, data).columns


def test_comparison_filters(spark):
    frame = spark.createDataFrame([(i, f"n{i}", i % 2 == 0) for i in range(6)], "size INT, name STRING, odd_lot BOOLEAN")

    def kept(**by):
        return sorted(r["size"] for r in refdata.compare_filter(frame, **by).collect())

    assert kept(size=2) == [2] and kept(size_lt=2) == [0, 1] and kept(size_lte=2) == [0, 1, 2]
    assert kept(size_gt=3) == [4, 5] and kept(size_gte=3, odd_lot=True) == [4]
    assert kept(name_any_of=["n1", "n5"]) == [1, 5] and kept(size=None) == list(range(6))
    with pytest.raises(DataValidationError):
        kept(price_lt=1)


def test_condition_names_keep_every_trade(spark):
    trades = spark.createDataFrame(
        [(1, [3, 9]), (2, []), (3, None), (4, [5]), (4, [3]), (None, [5, 3]), (None, [5, 3])], "sequence INT, conditions ARRAY<INT>")
    codes = spark.createDataFrame([(3, "late", False), (5, "odd", True)], "id INT, name STRING, ok BOOLEAN").select(
        "id", "name", F.struct(F.struct(F.col("ok").alias("updates_high_low")).alias("consolidated")).alias("update_rules"))
    found = refdata.with_condition_names(trades, codes)
    assert found.columns == ["sequence", "conditions", "condition_names", "updates_high_low"]
    assert sorted(((r.sequence, r.condition_names, r.updates_high_low) for r in found.collect()), key=str) == sorted([
        (1, ["late", None], False), (2, [], True), (3, None, None), (4, ["odd"], True), (4, ["late"], False),
        (None, ["odd", "late"], False), (None, ["odd", "late"], False)], key=str)


def test_book_depth(spark):
    book = spark.createDataFrame(
        [("A", 1, [(10.0, {"X": 3.0, "Y": 1.0}), (9.5, {"X": 2.0})], [(10.5, {"Z": 4.0})]), ("B", 1, [], [])],
        f"ticker STRING, updated BIGINT, bids {schemas.BOOK_LEVELS}, asks {schemas.BOOK_LEVELS}")
    found = {r.ticker: r for r in refdata.book_depth(book).collect()}
    a, b = found["A"], found["B"]
    assert (a.best_bid, a.best_ask, a.spread, a.midpoint, a.bid_count, a.ask_count) == (10.0, 10.5, 0.5, 10.25, 6.0, 4.0)
    assert (b.spread, b.bid_levels, b.bid_count) == (None, 0, 0.0)
    assert refdata.book_levels(book).count() == 4


def test_currency_conversion(spark):
    quotes = spark.createDataFrame(
        [("EUR/USD", 1.0, 1.2, 1, 1), ("EUR/USD", 1.2, 1.4, 1, 2), ("GBP/USD", 9.0, 9.0, 1, 1)],
        "pair STRING, bid DOUBLE, ask DOUBLE, timestamp BIGINT, sequence BIGINT")
    amounts = spark.createDataFrame(
        [(1, "EUR", "USD", 10.017), (2, "CHF", "USD", 5.0)],
        "id INT, from_currency STRING, to_currency STRING, amount DOUBLE")
    found = {r.id: r.converted for r in refdata.convert_currency(amounts, quotes, 1).collect()}
    assert found == {1: 13.0, 2: None}
    with pytest.raises(DataValidationError):
        refdata.convert_currency(amounts, quotes, 5)


def test_financials_from_nested_column_and_json(spark):
    text = '{"balance_sheet":{"assets":{"unit":"USD","value":5.0,"label":"Assets","order":1}},"income_statement":{}}'
    filings = spark.createDataFrame([("1", text)], "cik STRING, json STRING")
    by_json = refdata.financials_long(filings, "json", ["cik"])
    nested = filings.select("cik", F.from_json("json", schemas.STATEMENTS).alias("financials"))
    by_column = refdata.financials_long(nested, carry=["cik"])
    want = [("1", "balance_sheet", "assets", "Assets", "USD", 5.0, 1)]
    assert [tuple(r) for r in by_json.collect()] == want == [tuple(r) for r in by_column.collect()]


def test_landed_pages(spark, tmp_path):
    (tmp_path / "p1.json").write_text('{\n"results":[{"T":"A","o":1,"t":5,"n":2},{"T":"B","otc":true}],\n"next_url":"x"}')
    (tmp_path / "p2.json").write_text('{"status":"OK"}')
    found = landed.name_aggregate_keys(landed.read_pages(spark, str(tmp_path))).orderBy("ticker").collect()
    assert [(r.ticker, r.open, r.timestamp, r.transactions, r.otc, r.close) for r in found] == [
        ("A", 1.0, 5, 2, None, None), ("B", None, None, None, True, None)]
    with pytest.raises(ConfigurationError):
        landed.read_dataset(spark, "nothing", str(tmp_path))


def test_set_operations(spark):
    a = spark.createDataFrame([("T", "X"), ("T", "Y")], "topic STRING, sym STRING")
    b = spark.createDataFrame([("T", "Y"), ("Q", "Z")], "topic STRING, sym STRING")
    assert sorted(map(tuple, rows.reconcile(a, b).collect())) == [("Q", "Z", "remove"), ("T", "X", "add")]
    assert rows.missing_keys(a, b, ["sym"]).collect()[0].sym == "X"
    assert rows.distinct_rows(rows.stack([a, b, a])).count() == 3
    with pytest.raises(DataValidationError):
        rows.stack([])


def test_latest_row_breaks_ties_by_sequence(spark):
    frame = spark.createDataFrame([("A", 5, 1, "x"), ("A", 5, 2, "y"), ("A", 4, 9, "z")],
                                  "ticker STRING, ts INT, sequence INT, v STRING")
    assert [tuple(r) for r in rows.latest_row(frame, ["ticker"], ["ts", "sequence"]).collect()] == [("A", 5, 2, "y")]


def test_latest_row_by_one_number(spark):
    """Rows of numbers and times: NULL comes first in every place of the order, and whole rows stay together."""
    rng = random.Random(4)
    times = [None, *(f"2024-01-0{d} 10:00:00.{u:06d}" for d in (1, 2) for u in (0, 1, 999_999)), "1900-01-01 00:00:00", "9999-12-31 23:59:59"]
    picks = [(rng.choice("ABCDEFGH"), rng.choice(times), rng.choice([None, -(1 << 63), -1, 0, 7, (1 << 63) - 1]), rng.choice([None, 1.0, 2.0]), i)
             for i in range(400)] + [("N", None, None, 5.0, 900)]
    frame = spark.createDataFrame(picks, "k STRING, t STRING, q BIGINT, price DOUBLE, i BIGINT").withColumn("t", F.col("t").cast("timestamp_ntz"))
    for kind in ("timestamp_ntz", "timestamp", "date"):
        typed = frame.withColumn("t", F.col("t").cast(kind))
        for order in (["t", "q"], ["t"], ["q"]):
            plan = rows.latest_row(typed, ["k"], order)
            best = typed.groupBy("k").agg(F.max(F.struct(*order)).alias("o")).select("k", "o.*")
            found = {(r.k, *(r[c] for c in order)) for r in plan.collect()}
            assert found == {tuple(r) for r in best.collect()}
            assert {tuple(r) for r in plan.collect()} <= {tuple(r) for r in typed.collect()}
            assert "SortAggregate" not in plan._jdf.queryExecution().toString()
    texts = frame.withColumn("t", F.col("t").cast("string"))
    assert {(r.k, r.t) for r in rows.latest_row(texts, ["k"], ["t"]).collect()} == {tuple(r) for r in texts.groupBy("k").agg(F.max("t")).collect()}


@pytest.mark.parametrize("size", [1, 7, 1000, 20_000])
def test_chunks_on_executors(spark, size):
    sizes = map_chunks(spark.range(0, 12_345, 1, 3), lambda p: pd.DataFrame({"n": [len(p)]}), "n BIGINT", size)
    got = [r.n for r in sizes.collect()]
    assert sum(got) == 12_345 and max(got) <= size


def test_broadcast_goes_by_the_counted_size(spark):
    packed = settled(spark.range(2000).select(F.repeat(F.lit("x"), 50_000).alias("t")), "packed")
    hinted = "ResolvedHint"
    assert counted_bytes(packed) > 100_000_000
    assert hinted not in broadcast_if_counted(packed)._jdf.queryExecution().analyzed().toString()
    small = settled(spark.range(100).toDF("k"), "small")
    assert hinted in broadcast_if_counted(small)._jdf.queryExecution().analyzed().toString()
    assert broadcast_if_counted(small, counted_bytes(small) - 1) is small


def test_steering_tables_are_always_written(spark):
    counts = spark.range(1000).groupBy((F.col("id") % 3).alias("k")).count()
    read_back = steering(counts, "x")
    assert "Aggregate" not in read_back._jdf.queryExecution().analyzed().toString()
    assert sorted(map(tuple, read_back.collect())) == sorted(map(tuple, counts.collect()))


def test_work_dir_is_below_the_shared_folder(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert work_dir(spark, "x").startswith(root) and work_dir(spark, "x") != work_dir(spark, "x")


def test_build_session_returns_the_active_one(spark):
    assert build_session() is not None
    assert dt.date(2024, 1, 3).isoformat() == "2024-01-03"
