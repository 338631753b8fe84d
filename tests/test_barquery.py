"""Bar selection: arguments, date ends, years, columns, SQL form and pruning."""

from datetime import date, datetime

import pytest

from barloom.errors import DataNotFound, DataValidationError, PartitionNotFound
from barloom.plans import ingest
from barloom.plans.barquery import BarQuery, parse_day
from barloom.sources.barstore import BarStore


def frame(spark, stamps, ticker="AAPL"):
    rows = [(ticker, stamp, 100 + i, int(stamp[:4])) for i, stamp in enumerate(stamps)]
    return spark.createDataFrame(rows, "ticker STRING, t STRING, close BIGINT, year INT").selectExpr(
        "ticker", "CAST(t AS TIMESTAMP_NTZ) AS window_start_et", "close", "year")


def closes(df):
    return sorted(r.close for r in df.collect())


@pytest.mark.parametrize("stamps, start, end, kept", [
    (["2024-01-01 10:00:00", "2024-01-02 11:00:00", "2024-01-03 12:00:00", "2024-01-04 13:00:00",
      "2023-12-31 14:00:00"], "2024-01-01", "2024-01-03", [100, 101, 102]),
    (["2024-01-01 00:00:00", "2024-01-01 12:00:00", "2024-01-03 23:59:59", "2024-01-04 00:00:00"],
     "2024-01-01", "2024-01-03", [100, 101, 102]),
    (["2023-12-30 10:00:00", "2023-12-31 10:00:00", "2024-01-01 10:00:00", "2024-01-02 10:00:00"],
     "2023-12-31", "2024-01-01", [101, 102]),
    (["2024-01-01 09:30:00", "2024-06-01 09:30:00", "2024-12-31 09:30:00"],
     "2024-01-01", "2024-06-30", [100, 101]),
])
def test_date_range_includes_both_days(spark, stamps, start, end, kept):
    bars = frame(spark, stamps)
    query = BarQuery().with_date_range(start, end)
    assert closes(query.apply(bars)) == kept
    bars.createOrReplaceTempView("bars_view")
    assert closes(query.run_sql(spark, "bars_view")) == kept


def test_empty_result_is_lazy_unless_rows_are_required(spark):
    bars = frame(spark, ["2024-01-10 10:00:00"])
    query = BarQuery().with_date_range("2024-01-01", "2024-01-05")
    assert query.apply(bars).count() == 0
    with pytest.raises(DataNotFound):
        query.apply(bars, require_rows=True)


def test_argument_errors(spark):
    with pytest.raises(DataValidationError):
        BarQuery().with_date_range("2024-12-31", "2024-01-01")
    with pytest.raises(DataValidationError):
        parse_day("31/12/2024")
    with pytest.raises(DataValidationError):
        parse_day(5)
    with pytest.raises(DataValidationError):
        BarQuery.build(start_date="2024-01-01")
    with pytest.raises(DataValidationError, match="nope"):
        BarQuery().with_columns(["close", "nope"]).apply(frame(spark, ["2024-01-10 10:00:00"]))
    no_time = frame(spark, ["2024-01-10 10:00:00"]).drop("window_start_et")
    with pytest.raises(DataValidationError):
        BarQuery().with_date_range("2024-01-01", "2024-01-05").apply(no_time)


def test_dates_are_read_from_all_accepted_forms():
    day = date(2024, 1, 3)
    assert [parse_day(x) for x in ("2024-01-03", "2024-01-03 10:00:00", day, datetime(2024, 1, 3, 9))] == [day] * 4


def test_years_and_range_intersect():
    query = BarQuery.build(years=[2021, 2023], start_date="2022-05-01", end_date="2024-01-01")
    assert query.partition_years() == [2023]
    assert BarQuery.build(tickers="a").partition_years() is None
    assert BarQuery.build(default_year=2020).partition_years() == [2020]
    assert BarQuery.build(years=2019, default_year=2020).partition_years() == [2019]


def test_ticker_case():
    assert BarQuery().with_tickers("aapl").tickers == ["AAPL"]
    assert BarQuery().with_tickers(["BCpC"], exact_case=True).tickers == ["BCpC"]


def test_column_order_is_the_callers(spark):
    assert BarQuery().with_columns(["close", "ticker"]).apply(
        frame(spark, ["2024-01-10 10:00:00"])).columns == ["close", "ticker"]


def test_sql_text():
    text, args = BarQuery.build(["aapl", "msft"], 2024, columns=["ticker", "close"]).to_sql("v")
    assert text == "SELECT `ticker`, `close` FROM v WHERE year IN (:y0) AND ticker IN (:t0, :t1)"
    assert args == {"y0": 2024, "t0": "AAPL", "t1": "MSFT"}
    assert BarQuery().to_sql("v") == ("SELECT * FROM v", {})


def test_sql_values_are_bound_not_pasted(spark):
    frame(spark, ["2024-01-10 10:00:00"]).createOrReplaceTempView("bars_view")
    assert BarQuery().with_tickers("x' OR 'a'='a").run_sql(spark, "bars_view").count() == 0


def test_partition_paths():
    query = BarQuery.build(["aapl"], [2023, 2024])
    assert query.partition_paths("/s/") == ["/s/year=2023/ticker=AAPL", "/s/year=2024/ticker=AAPL"]
    assert BarQuery().partition_paths("/s") == ["/s/year=*/ticker=*"]
    odd = BarQuery.build(["BRK/A", "A B", "*", "50%[x]", ""], 2024, exact_case=True)
    assert [p.rpartition("=")[2] for p in odd.partition_paths("/s")] == [
        "BRK%2FA", "A B", "%2A", "50%25%5Bx%5D", "__HIVE_DEFAULT_PARTITION__"]


@pytest.fixture(scope="module")
def small_store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store") / "bars")
    rows = [(t, f"{y}-03-0{d} 10:00:00", 1.0, 2.0, 0.5, 1.5, 10, 1, y)
            for t in ("AAPL", "MSFT", "BRK/A", "BCpC") for y in (2023, 2024) for d in (4, 5) if (t, y) != ("MSFT", 2023)]
    bars = spark.createDataFrame(
        rows, "ticker STRING, t STRING, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT, "
              "transactions BIGINT, year INT").selectExpr(
        "ticker", "CAST(t AS TIMESTAMP_NTZ) AS window_start_et", "open", "high", "low", "close", "volume",
        "transactions", "year")
    ingest.write_bars(bars, root)
    return BarStore(spark, root)


def test_plan_prunes_partitions_rows_and_columns(small_store):
    picked = small_store.get_bars("AAPL", start_date="2024-03-04", end_date="2024-03-04", columns=["close"])
    plan = picked._jdf.queryExecution().executedPlan().toString()
    partition = plan[plan.index("PartitionFilters"):plan.index("PushedFilters")]
    assert "2024" in partition and "AAPL" in partition
    pushed = plan[plan.index("PushedFilters"):]
    assert "GreaterThanOrEqual(window_start_et" in pushed and "LessThan(" in pushed
    assert "volume" not in plan[plan.index("ReadSchema"):]
    assert picked.count() == 1


def test_partition_listing(small_store):
    def listed(**by):
        return sorted((r.year, r.ticker, r.files) for r in small_store.partitions(**by).collect())

    assert listed(year=2023) == [(2023, "AAPL", 1), (2023, "BCpC", 1), (2023, "BRK/A", 1)]
    assert listed(ticker="aapl") == [(2023, "AAPL", 1), (2024, "AAPL", 1)]
    assert listed(year=2024, ticker="MSFT") == [(2024, "MSFT", 1)]
    assert listed(year=2020) == []
    assert [r.ticker for r in small_store.tickers().collect()] == ["AAPL", "BCpC", "BRK/A", "MSFT"]
    assert [r.year for r in small_store.years().collect()] == [2023, 2024]
    assert small_store.exists(2024, "MSFT") and not small_store.exists(2023, "MSFT")


def test_listed_partitions_skip_missing_ones(small_store):
    found = small_store.scan_partitions([(2024, "MSFT"), (2023, "MSFT")])
    assert {(r.year, r.ticker) for r in found.collect()} == {(2024, "MSFT")}
    with pytest.raises(PartitionNotFound):
        small_store.scan_partitions([(1990, "MSFT")])


def test_scan_of_partition_folders(small_store):
    query = BarQuery.build(["AAPL", "MSFT"], [2023, 2024])
    found = small_store.scan_paths(query.partition_paths(small_store.root))
    assert {(r.year, r.ticker) for r in found.collect()} == {(2023, "AAPL"), (2024, "AAPL"), (2024, "MSFT")}
    assert small_store.scan_paths(BarQuery().partition_paths(small_store.root)).count() == small_store.scan().count()
    with pytest.raises(PartitionNotFound):
        small_store.scan_paths(BarQuery.build("NONE", 2024).partition_paths(small_store.root))


def test_every_ticker_is_found_by_its_folder(spark, tmp_path):
    """The folder of each name is the one Spark wrote, whatever character it holds."""
    names = ["BRK/A", "A B", "50%:X=1", "^GSPC", "a'b\"c", "x[1]{2}?", "*", "tab\tnl\n", "BCpC", "é漢", "back\\slash", "A#1", "%2F"]
    rows = [(t, None, 1.0, 2.0, 0.5, float(i), 10, 1, 2024) for i, t in enumerate(names)]
    root = str(tmp_path / "odd")
    columns = "ticker STRING, window_start_et TIMESTAMP_NTZ, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT, transactions BIGINT, year INT"
    spark.createDataFrame(rows, columns).write.partitionBy("year", "ticker").parquet(root)
    store = BarStore(spark, root)
    for i, name in enumerate(names):
        found = store.scan_paths(BarQuery.build(name, 2024, exact_case=True).partition_paths(root)).collect()
        assert [(r.ticker, r.close) for r in found] == [(name, float(i))]


def test_missing_store(spark, tmp_path):
    nowhere = BarStore(spark, str(tmp_path / "none"))
    with pytest.raises(DataNotFound):
        nowhere.scan()
    row = nowhere.health().first()
    assert row.status == "unhealthy" and row.issues == ["the store holds no partition"]
    assert nowhere.stored_tickers().count() == 0


def test_driver_chunks(small_store):
    sizes = [len(piece) for piece in small_store.stream_bars(chunk_size=3, years=2024)]
    assert sizes == [3, 3, 2]
