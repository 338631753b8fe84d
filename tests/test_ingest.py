"""Flat files to the bar store: time zones, filters, idempotency, compaction and repair."""

import gzip

import pytest
from pyspark.sql import functions as F

from barloom import schemas
from barloom.errors import DataNotFound, DataValidationError
from barloom.functions import clock
from barloom.plans import ingest, maintain
from barloom.plans.export import export_splits
from barloom.sources import flatfiles
from barloom.sources.barstore import BarStore

HEADER = "ticker,volume,open,close,high,low,window_start,transactions"
# Own prices; two winter and two summer days, one ticker with a slash and one with a space.
ROWS = [
    "KOVA,310,41.25,41.5,41.75,41.0,1738765800000000000,7",
    "BRK/A,4,700100.0,700250.0,700300.0,700000.0,1738767000000000000,3",
    "Q RU,95,8.5,8.25,8.75,8.125,1738770660000000000,5",
    "KOVA,280,42.0,41.875,42.5,41.5,1752242400000000000,6",
    "BRK/A,6,720000.0,719500.0,720100.0,719000.0,1752501600000000000,2",
]


def write_csv(folder, name, rows, header=HEADER):
    folder.mkdir(parents=True, exist_ok=True)
    with gzip.open(folder / name, "wt") as out:
        out.write("\n".join([header, *rows]) + "\n")
    return str(folder / name)


def stored(spark, root):
    return sorted(tuple(r) for r in BarStore(spark, root).scan().select("ticker", "close", "year").collect())


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
@pytest.mark.parametrize("ns, expected", [
    (1738762200000000000, "2025-02-05 08:30:00"),
    (1738766645123456789, "2025-02-05 09:44:05.123456"),
    (1741613400000000000, "2025-03-10 09:30:00"),
    (1762180200000000000, "2025-11-03 09:30:00"),
    # Both passes of the repeated hour when summer time ends.
    (1762061400000000000, "2025-11-02 01:30:00"),
    (1762065000000000000, "2025-11-02 01:30:00"),
])
def test_market_time_does_not_depend_on_the_session_zone(spark, zone, ns, expected):
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        row = spark.createDataFrame([(ns,)], "ns BIGINT").select(
            clock.market_from_epoch(F.col("ns")).cast("string").alias("et"),
            clock.epoch_ns(clock.utc_from_epoch(F.col("ns"))).alias("back")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row.et == expected and row.back == ns // 1000 * 1000


def test_trading_hours_edges(spark):
    stamps = ["2023-06-07 09:29:59", "2023-06-07 09:30:00", "2023-06-08 13:45:30", "2023-06-09 15:59:59",
              "2023-06-09 16:00:00", "2023-06-09 18:20:00", "2023-06-10 11:00:00", "2023-06-11 10:15:00"]
    bars = spark.createDataFrame([(s,) for s in stamps], "t STRING").selectExpr(
        "CAST(t AS TIMESTAMP_NTZ) AS window_start_et")
    kept = sorted(str(r[0]) for r in ingest.trading_hours_only(bars).collect())
    assert kept == stamps[1:4]


def test_ingest_writes_one_file_per_partition_and_is_idempotent(spark, tmp_path):
    source = write_csv(tmp_path / "in", "2025-02-05.csv.gz", ROWS)
    root = str(tmp_path / "store")
    report = ingest.ingest_bars(spark, source, root)
    assert (report.rows_written, report.tickers_written) == (5, 3)
    bars = BarStore(spark, root).scan()
    assert set(bars.columns) == set(schemas.CLEAN_BAR_COLUMNS)
    assert bars.filter("volume > 0 AND open > 0 AND high >= open AND open >= low AND year = 2025").count() == 5
    assert [r.files for r in BarStore(spark, root).partitions().collect()] == [1, 1, 1]
    before = stored(spark, root)
    again = ingest.ingest_bars(spark, source, root)
    assert (again.rows_written, again.tickers_written) == (0, 0)
    assert stored(spark, root) == before


def test_only_missing_tickers_are_added(spark, tmp_path):
    source = write_csv(tmp_path / "in", "2025-02-05.csv.gz", ROWS)
    root = str(tmp_path / "store")
    ingest.ingest_bars(spark, source, root, tickers=["KOVA"])
    assert ingest.ingest_bars(spark, source, root).tickers_written == 2
    assert BarStore(spark, root).scan().count() == 5


def test_overwrite_keeps_other_partitions(spark, tmp_path):
    source = write_csv(tmp_path / "in", "2025-02-05.csv.gz", ROWS)
    root = str(tmp_path / "store")
    ingest.ingest_bars(spark, source, root)
    one = BarStore(spark, root).scan().filter("ticker = 'BRK/A'").limit(1)
    staged = str(tmp_path / "one")
    one.write.parquet(staged)
    ingest.write_bars(spark.read.parquet(staged).select(*schemas.CLEAN_BAR_COLUMNS), root, "overwrite")
    assert {t: n for t, n in BarStore(spark, root).scan().groupBy("ticker").count().collect()} == {
        "KOVA": 2, "Q RU": 1, "BRK/A": 1}


def test_weekend_writes_nothing(spark, tmp_path):
    saturday = [r.replace("1738765800", "1739025000") for r in ROWS[:1]]
    source = write_csv(tmp_path / "in", "2025-02-08.csv.gz", saturday)
    report = ingest.ingest_bars(spark, source, str(tmp_path / "store"))
    assert report.rows_written == 0


def test_columns_by_name_and_safe_casts(spark, tmp_path):
    source = write_csv(tmp_path / "in", "x.csv.gz", ["1738767123000000000,KOVA,1000.5,1,2,3,oops,5"],
                       "window_start,ticker,volume,low,open,close,high,transactions")
    row = flatfiles.read_raw_bars(spark, source).first()
    assert (row.ticker, row.volume, row.low, row.open, row.close, row.high, row.transactions) == (
        "KOVA", 1000, 1.0, 2.0, 3.0, None, 5)


def test_missing_column_and_missing_files(spark, tmp_path):
    source = write_csv(tmp_path / "in", "x.csv.gz", ["KOVA,1"], "ticker,volume")
    with pytest.raises(DataValidationError, match="close"):
        flatfiles.read_raw_bars(spark, source)
    with pytest.raises(DataNotFound):
        flatfiles.read_raw_bars(spark, str(tmp_path / "none" / "*.csv.gz"))


def test_rejected_rows_go_to_quarantine(spark, tmp_path):
    bad = [",1,1,1,1,1,1738767123000000000,1", "KOVA,1,1,1,1,1,,1"]
    source = write_csv(tmp_path / "in", "x.csv.gz", ROWS + bad)
    aside = str(tmp_path / "aside")
    report = ingest.ingest_bars(spark, source, str(tmp_path / "store"), quarantine=aside)
    assert (report.rows_written, report.rows_rejected) == (5, 2)
    ingest.ingest_bars(spark, source, str(tmp_path / "store"), quarantine=aside)
    assert spark.read.parquet(aside).count() == 2


def test_odd_numbers_do_not_end_the_load(spark, tmp_path):
    source = write_csv(tmp_path / "in", "x.csv.gz", [
        "KOVA,NaN,1,1,1,1,1738767123000000000,1e30", "KOVA,9007199254740993,1,1,1,1,1738767123000000001,", "KOVA,12.9,oops,1,1,1,Infinity,-3"])
    found = [(r.volume, r.transactions, r.window_start) for r in flatfiles.read_raw_bars(spark, source).collect()]
    assert found == [(None, None, 1738767123000000000), (9007199254740993, None, 1738767123000000001), (12, -3, None)]


def test_manifest(spark, tmp_path):
    for name in ("2025-02-04", "2025-02-05", "2025-02-06", "notes"):
        write_csv(tmp_path / "in" / "deep", f"{name}.csv.gz", ROWS[:1])
    landed = spark.createDataFrame([("2025-02-05.csv.gz",)], "name STRING")
    found = flatfiles.manifest(spark, str(tmp_path / "in"), "2025-02-04", "2025-02-05", landed)
    assert [r.name for r in found.collect()] == ["2025-02-04.csv.gz"]
    raw = flatfiles.read_raw_bars(spark, str(tmp_path / "in"), recursive=True, name_glob="2025-*.csv.gz")
    assert raw.count() == 3


def test_compaction_merges_files_and_drops_copies(spark, tmp_path):
    source = write_csv(tmp_path / "in", "2025-02-05.csv.gz", ROWS)
    root = str(tmp_path / "store")
    ingest.ingest_bars(spark, source, root)
    copy = BarStore(spark, root).scan()
    ingest.write_bars(copy, root)
    report = maintain.compact(spark, root)
    assert (report.files_before, report.files_after) == (6, 3)
    assert (report.rows_before, report.rows_after) == (10, 5)
    assert BarStore(spark, root).scan().count() == 5


def test_repair_rebuilds_only_broken_partitions(spark, tmp_path):
    source = write_csv(tmp_path / "in", "2025-02-05.csv.gz", ROWS)
    root = tmp_path / "store"
    ingest.ingest_bars(spark, source, str(root))
    before = stored(spark, str(root))
    (root / "year=2025" / "ticker=BRK%2FA" / "part-bad.parquet").write_bytes(b"not parquet")
    broken = maintain.corrupt_files(spark, str(root)).collect()
    assert [(r.year, r.ticker) for r in broken] == [(2025, "BRK/A")]
    fixed = maintain.repair(spark, str(root), source)
    assert [tuple(r) for r in fixed.collect()] == [(2025, "BRK/A", True)]
    assert stored(spark, str(root)) == before
    assert maintain.corrupt_files(spark, str(root), deep=True).count() == 0


def test_repair_keeps_readable_rows_and_names_what_it_cannot_rebuild(spark, tmp_path):
    source = write_csv(tmp_path / "in", "2025-02-05.csv.gz", ROWS)
    root = tmp_path / "store"
    ingest.ingest_bars(spark, source, str(root))
    assert maintain.corrupt_files(spark, str(root), deep=True).count() == 0
    before = stored(spark, str(root))
    for folder in ("BRK%2FA", "Q RU"):
        (root / "year=2025" / f"ticker={folder}" / "part-bad.parquet").write_bytes(b"PAR1 of old times")
    less = write_csv(tmp_path / "less", "2025-02-05.csv.gz", ROWS[1:2])
    fixed = {r.ticker: r.rebuilt for r in maintain.repair(spark, str(root), less).collect()}
    assert fixed == {"BRK/A": True, "Q RU": False}
    left = maintain.corrupt_files(spark, str(root)).collect()
    assert [r.ticker for r in left] == ["Q RU"] and "part-bad" in left[0].path and left[0].error
    assert sorted(tuple(r) for r in BarStore(spark, str(root)).scan(ignore_corrupt=True).select("ticker", "close", "year").collect()) == before
    health = BarStore(spark, str(root)).health().first()
    assert health.status == "unhealthy" and [i for i in health.issues if "part-bad" in i] and health.rows == 5


def test_a_place_that_fails_is_not_called_corrupt(spark, tmp_path, monkeypatch):
    source = write_csv(tmp_path / "in", "2025-02-05.csv.gz", ROWS)
    root = tmp_path / "store"
    ingest.ingest_bars(spark, source, str(root))
    with pytest.raises(Exception):
        maintain.corrupt_files(spark, "nosuchscheme://host/store").count()
    # A file that vanishes between the listing and the look at its bytes.
    bad = root / "year=2025" / "ticker=KOVA" / "part-bad.parquet"
    bad.write_bytes(b"not parquet")
    real = maintain._reader_error
    monkeypatch.setattr(maintain, "_reader_error", lambda *a: pytest.fail("asked for the format of a file that cannot be read"))
    text = type(spark.read).text
    monkeypatch.setattr(type(spark.read), "text", lambda self, paths, *a: (bad.unlink(), text(self, paths, *a))[1])
    with pytest.raises(Exception):
        maintain.corrupt_files(spark, str(root)).count()
    assert real is not None


def test_damaged_pages_are_found_by_the_deep_check(spark, tmp_path):
    source = write_csv(tmp_path / "in", "2025-02-05.csv.gz", ROWS)
    root = tmp_path / "store"
    ingest.ingest_bars(spark, source, str(root))
    victim = next((root / "year=2025" / "ticker=KOVA").glob("*.parquet"))
    data = bytearray(victim.read_bytes())
    data[4:80] = b"\xff" * 76
    victim.write_bytes(data)
    for leftover in victim.parent.glob(".*.crc"):
        leftover.write_bytes(b"")
    assert maintain.corrupt_files(spark, str(root)).count() == 0
    assert [r.ticker for r in maintain.corrupt_files(spark, str(root), deep=True).collect()] == ["KOVA"]


def test_splits_export_always_has_a_header(spark, tmp_path):
    splits = spark.createDataFrame(
        [("a", "2024-01-02", 1.0, 2.0, "X"), ("b", "2024-01-01", 1.0, 3.0, "Y"), ("c", "2024-02-01", 1.0, 4.0, "Z")],
        "id STRING, execution_date STRING, split_from DOUBLE, split_to DOUBLE, ticker STRING").withColumn(
        "execution_date", F.to_date("execution_date"))
    path = export_splits(splits, str(tmp_path), "2024-01-15")
    assert path.endswith("split_data_2024-01-15")
    rows = spark.read.option("header", True).csv(path).collect()
    assert [r.id for r in rows] == ["b", "a"]
    empty = export_splits(splits, str(tmp_path), "2020-01-01")
    assert spark.read.option("header", True).csv(empty).columns == schemas.SPLIT_EXPORT_COLUMNS


def test_a_hot_partition_is_split_over_files(spark, tmp_path):
    """Beyond the advisory size a ticker's year is written by several tasks, whole."""
    minute = F.timestamp_add("MINUTE", F.col("id"), F.expr("timestamp_ntz'2024-01-01 00:00:00'"))
    bars = spark.range(0, 60_000, 1, 8).select(
        F.when(F.col("id") % 100 < 97, "HOT").otherwise(F.concat(F.lit("T"), F.col("id") % 100)).alias("ticker"),
        minute.alias("window_start_et"), *[F.rand(i).alias(c) for i, c in enumerate(("open", "high", "low", "close"))],
        F.col("id").alias("volume"), F.col("id").alias("transactions"), F.lit(2024).alias("year"))
    root = str(tmp_path / "store")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200KB")
    try:
        ingest.write_bars(bars, root)
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "128MB")
    files = {r.ticker: r.files for r in BarStore(spark, root).partitions().collect()}
    assert files["HOT"] > 2
    assert BarStore(spark, root).scan().agg(F.sum("volume"), F.count("*")).first() == (60_000 * 59_999 // 2, 60_000)


def test_command_line(spark, tmp_path, capsys):
    source = write_csv(tmp_path / "in", "2025-02-05.csv.gz", ROWS)
    ingest.main([source, str(tmp_path / "store"), "--year", "2025", "--tickers", "KOVA,BRK/A"])
    assert "rows_written=4" in capsys.readouterr().out
    assert BarStore(spark, str(tmp_path / "store")).scan().count() == 4


def test_suspects_are_halved_not_read_one_by_one(spark, tmp_path, monkeypatch):
    """200 files without rows cost one job; two broken ones among them about two times the logarithm each."""
    layout = "ticker STRING, close DOUBLE, year INT"
    empty = tmp_path / "one"
    spark.createDataFrame([], "ticker STRING, close DOUBLE").coalesce(1).write.parquet(str(empty))
    whole = next(empty.glob("*.parquet")).read_bytes()
    root = tmp_path / "store" / "year=2025"
    root.mkdir(parents=True)
    for i in range(200):
        (root / f"part-{i:03d}.parquet").write_bytes(whole)
    asked = []
    plain = maintain._reader_error
    monkeypatch.setattr(maintain, "_reader_error", lambda spark, files: asked.append(len(files)) or plain(spark, files))
    assert maintain.corrupt_files(spark, str(tmp_path / "store"), layout=layout).count() == 0 and asked == [200]
    asked.clear()
    for name in ("part-bad.parquet", "part-007-bad.parquet"):
        (root / name).write_bytes(b"PAR1 of old times")
    found = maintain.corrupt_files(spark, str(tmp_path / "store"), deep=True, layout=layout).collect()
    assert sorted(r.path.rpartition("/")[2] for r in found) == ["part-007-bad.parquet", "part-bad.parquet"] and all(r.error for r in found)
    assert len(asked) <= 2 * 2 * 9
