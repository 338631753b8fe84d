"""Operators over reference data, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom import schemas
from barloom.functions import paths
from barloom.operators import refdata, rows
from barloom.plans.export import due_splits, export_splits
from barloom.session import work_dir
from barloom.sources import landed
from barloom.sources.flatfiles import select_files
from barloom.workload import query
from barloom.workload.inputs import bars, day, moment, portable, r, sql, table, trades

_SPLITS_SQL = (
    "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, CAST(l_shipdate AS DATE) AS execution_date, "
    "CAST(l_linenumber AS DOUBLE) AS split_from, l_quantity AS split_to, 'P' || l_partkey AS ticker FROM lineitem")


def splits(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"),
        F.to_date("l_shipdate").alias("execution_date"), F.col("l_linenumber").cast("double").alias("split_from"),
        F.col("l_quantity").alias("split_to"), F.concat(F.lit("P"), F.col("l_partkey")).alias("ticker"))


_SPLIT_COLUMNS = f"id, {day('execution_date')} AS execution_date, {r('split_from')} AS split_from, {r('split_to')} AS split_to, ticker"


@query("reverse_splits", sql(
    f"SELECT {_SPLIT_COLUMNS} FROM s WHERE split_from > split_to AND execution_date >= DATE '1996-01-01'",
    s=_SPLITS_SQL))
def reverse_splits(spark, sf_dir):
    return portable(refdata.list_splits(
        splits(spark, sf_dir), reverse_split=True, execution_date_gte="1996-01-01"))


@query("forward_splits_top", sql(
    f"SELECT {_SPLIT_COLUMNS} FROM s WHERE split_from <= split_to AND split_from IN (2, 3) "
    "ORDER BY s.execution_date DESC, id LIMIT 25", s=_SPLITS_SQL))
def forward_splits_top(spark, sf_dir):
    kept = refdata.list_splits(
        splits(spark, sf_dir), reverse_split=False, split_from_any_of=[2.0, 3.0])
    return portable(rows.sorted_limit(kept, "execution_date", "desc", 25, ["id"]))


@query("splits_due", sql(
    f"SELECT {_SPLIT_COLUMNS} FROM s WHERE execution_date <= DATE '1997-06-30'", s=_SPLITS_SQL))
def splits_due(spark, sf_dir):
    return portable(due_splits(splits(spark, sf_dir), "1997-06-30"))


@query("splits_export", sql(
    f"SELECT {_SPLIT_COLUMNS} FROM s WHERE execution_date <= DATE '1997-06-30'", s=_SPLITS_SQL))
def splits_export(spark, sf_dir):
    target = export_splits(splits(spark, sf_dir), work_dir(spark, "export"), "1997-06-30")
    return portable(landed.read_dataset(spark, "splits", target, "csv"))


_DIVIDENDS_SQL = (
    "SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, l_discount * 10 AS cash_amount, "
    "CASE l_returnflag WHEN 'A' THEN 'CD' WHEN 'N' THEN 'SC' ELSE 'LT' END AS dividend_type, "
    "CAST(l_shipdate AS DATE) AS ex_dividend_date, CAST(l_linenumber AS BIGINT) AS frequency, "
    "'P' || l_partkey AS ticker FROM lineitem")


@query("dividends_filter", sql(
    f"SELECT id, {r('cash_amount')} AS cash_amount, dividend_type, {day('ex_dividend_date')} AS ex_dividend_date, "
    "frequency, ticker FROM d WHERE dividend_type = 'CD' AND cash_amount > 0.25 AND cash_amount <= 0.75 "
    "AND frequency = 4 AND ex_dividend_date < DATE '1999-01-01'", d=_DIVIDENDS_SQL))
def dividends_filter(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "A", "CD").when(F.col("l_returnflag") == "N", "SC").otherwise("LT")
    source = table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey").alias("id"),
        (F.col("l_discount") * 10).alias("cash_amount"), kind.alias("dividend_type"),
        F.to_date("l_shipdate").alias("ex_dividend_date"), F.col("l_linenumber").alias("frequency"),
        F.concat(F.lit("P"), F.col("l_partkey")).alias("ticker"))
    return portable(refdata.list_dividends(
        source, dividend_type="CD", cash_amount_gt=0.25, cash_amount_lte=0.75, frequency=4,
        ex_dividend_date_lt="1999-01-01"))


_DIRECTORY_SQL = (
    "SELECT 'P' || p_partkey AS ticker, p_name AS name, p_type AS type, p_brand AS market, "
    "CAST(p_size AS BIGINT) AS exchange, p_retailprice >= 930 AS active FROM part")


def directory(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey")).alias("ticker"), F.col("p_name").alias("name"),
        F.col("p_type").alias("type"), F.col("p_brand").alias("market"), F.col("p_size").alias("exchange"),
        (F.col("p_retailprice") >= 930).alias("active"))


@query("tickers_search", sql(
    "SELECT * FROM t WHERE (contains(lower(ticker), 'p1') OR contains(lower(name), 'p1')) AND active "
    "AND exchange <= 25", t=_DIRECTORY_SQL))
def tickers_search(spark, sf_dir):
    return portable(refdata.list_tickers(directory(spark, sf_dir), search="P1", active=True, exchange_lte=25))


_CONTRACTS_SQL = (
    "SELECT 'O:' || l_orderkey || ':' || l_linenumber || ':' || l_partkey AS ticker, 'P' || l_partkey AS underlying_ticker, "
    "l_extendedprice AS strike_price, CAST(l_shipdate AS DATE) AS expiration_date, "
    "CASE WHEN l_linestatus = 'O' THEN 'call' ELSE 'put' END AS contract_type FROM lineitem")


@query("options_filter", sql(
    f"SELECT ticker, underlying_ticker, {r('strike_price')} AS strike_price, "
    f"{day('expiration_date')} AS expiration_date, contract_type FROM c WHERE contract_type = 'call' "
    "AND strike_price >= 20000 AND strike_price < 60000 AND expiration_date >= DATE '1998-01-01'", c=_CONTRACTS_SQL))
def options_filter(spark, sf_dir):
    contracts = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("O:"), F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey")).alias("ticker"),
        F.concat(F.lit("P"), F.col("l_partkey")).alias("underlying_ticker"),
        F.col("l_extendedprice").alias("strike_price"), F.to_date("l_shipdate").alias("expiration_date"),
        F.when(F.col("l_linestatus") == "O", "call").otherwise("put").alias("contract_type"))
    return portable(refdata.list_options_contracts(
        contracts, as_of="1998-01-01", expired=False, contract_type="call", strike_price_gte=20000,
        strike_price_lt=60000))


_FILINGS_SQL = (
    "SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS cik, c_name AS company_name, "
    "CAST(o_orderdate AS DATE) AS filing_date, o_orderpriority AS timeframe "
    "FROM orders JOIN customer ON c_custkey = o_custkey")


@query("financials_filter", sql(
    f"SELECT id, cik, company_name, {day('filing_date')} AS filing_date, timeframe FROM f "
    "WHERE contains(lower(company_name), '1') AND filing_date >= DATE '1996-01-01' "
    "AND filing_date <= DATE '1996-12-31' AND timeframe = '1-URGENT'", f=_FILINGS_SQL))
def financials_filter(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("company_name"))
    filings = table(spark, sf_dir, "orders").join(
        customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("cik"), "company_name",
        F.to_date("o_orderdate").alias("filing_date"), F.col("o_orderpriority").alias("timeframe"))
    return portable(refdata.list_financials(
        filings, company_name_search="1", filing_date_gte="1996-01-01", filing_date_lte="1996-12-31",
        timeframe="1-URGENT"))


@query("ipos_list", sql(
    f"SELECT 'I' || o_orderkey AS ticker, 'Customer ' || o_custkey AS issuer_name, "
    f"{day('o_orderdate')} AS listing_date, o_orderstatus AS ipo_status FROM orders WHERE o_orderstatus = 'P' "
    "ORDER BY o_orderdate DESC, ticker LIMIT 40"))
def ipos_list(spark, sf_dir):
    ipos = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("I"), F.col("o_orderkey")).alias("ticker"),
        F.concat(F.lit("Customer "), F.col("o_custkey")).alias("issuer_name"),
        F.to_date("o_orderdate").alias("listing_date"), F.col("o_orderstatus").alias("ipo_status"))
    kept = refdata.list_ipos(ipos, ipo_status="P")
    return portable(rows.sorted_limit(kept, "listing_date", "desc", 40, ["ticker"]))


@query("otc_filter", sql(
    "SELECT ticker, count(*) AS n FROM wide_trades WHERE NOT coalesce(CASE WHEN size > 10 THEN size > 80 END, false) "
    "GROUP BY 1", "wide_trades"))
def otc_filter(spark, sf_dir):
    marked = trades(spark, sf_dir, wide=True).withColumn("otc", F.when(F.col("size") > 10, F.col("size") > 80))
    return portable(refdata.without_otc(marked).groupBy("ticker").agg(F.count("*").alias("n")))


@query("trades_range", sql(
    f"SELECT sequence AS sequence_number, {moment('ts')} AS ts, {r('price')} AS price FROM trades "
    "WHERE ticker = 'CLICK' AND trades.ts >= TIMESTAMP '2024-01-05 00:00:00' AND trades.ts < TIMESTAMP '2024-01-15 00:00:00' "
    "ORDER BY trades.ts DESC, sequence LIMIT 500", "trades"))
def trades_range(spark, sf_dir):
    from barloom.functions import clock
    ticks = trades(spark, sf_dir).select(
        "ticker", "ts", "price", F.col("sequence").alias("sequence_number"),
        clock.epoch_ns(F.col("ts")).alias("sip_timestamp"))
    kept = refdata.ticks_between(
        ticks, "CLICK", order="desc", limit=500,
        sip_timestamp_gte=1704412800000000000, sip_timestamp_lt=1705276800000000000)
    return portable(kept.select("sequence_number", "ts", "price"))


@query("exchange_lookup",
       "SELECT s_suppkey AS listing, CAST(s_nationkey AS BIGINT) AS exchange, n_name AS exchange_name, "
       "r_name AS locale FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey "
       "LEFT JOIN region ON r_regionkey = n_regionkey")
def exchange_lookup(spark, sf_dir):
    listings = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("listing"), F.col("s_nationkey").alias("exchange"))
    exchanges = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("exchange"), F.col("n_name").alias("exchange_name"), "n_regionkey")
    locales = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("locale"))
    found = refdata.with_lookup(listings, refdata.with_lookup(exchanges, locales, ["n_regionkey"]), ["exchange"])
    return portable(found.select("listing", "exchange", "exchange_name", "locale"))


@query("related_companies",
       "SELECT DISTINCT 'P' || l_partkey AS ticker, 'P' || l_suppkey AS related, p_name AS related_name "
       "FROM lineitem LEFT JOIN part ON p_partkey = l_suppkey")
def related_companies(spark, sf_dir):
    related = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("P"), F.col("l_partkey")).alias("ticker"),
        F.concat(F.lit("P"), F.col("l_suppkey")).alias("related")).distinct()
    return portable(refdata.related_companies(related, directory(spark, sf_dir)).select(
        "ticker", "related", "related_name"))


def conditions(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"),
        F.struct(F.struct((F.col("n_regionkey") != 2).alias("updates_high_low")).alias("consolidated"))
        .alias("update_rules"))


def trades_with_conditions(spark, sf_dir):
    return trades(spark, sf_dir).withColumn(
        "conditions", F.array((F.col("size") % 30).cast("int"), (F.col("user_id") % 25).cast("int")))


_CONDITIONS_SQL = (
    "SELECT sequence, coalesce(a.n_name, '?') || ',' || coalesce(b.n_name, '?') AS names, "
    "coalesce(a.n_regionkey <> 2, true) AND coalesce(b.n_regionkey <> 2, true) AS updates_high_low "
    "FROM trades LEFT JOIN nation a ON a.n_nationkey = size % 30 LEFT JOIN nation b ON b.n_nationkey = user_id % 25")


def _named(found):
    text = F.array_join("condition_names", ",", "?")
    return portable(found.select("sequence", text.alias("names"), "updates_high_low"))


@query("condition_lookup", sql(_CONDITIONS_SQL, "trades"))
def condition_lookup(spark, sf_dir):
    return _named(refdata.with_condition_names(trades_with_conditions(spark, sf_dir), conditions(spark, sf_dir)))


@query("condition_lookup_joined", sql(
    _CONDITIONS_SQL.replace("SELECT sequence", "SELECT CASE WHEN size > 5 THEN sequence END AS sequence").replace(
        "FROM trades", "FROM (FROM trades UNION ALL FROM trades)"), "trades"))
def condition_lookup_joined(spark, sf_dir):
    """Trades that come twice, many of them without a key: each row keeps its own names."""
    once = trades_with_conditions(spark, sf_dir).withColumn("sequence", F.when(F.col("size") > 5, F.col("sequence")))
    return _named(refdata.with_condition_names(once.union(once), conditions(spark, sf_dir)))


def news(spark, sf_dir):
    """Documents as articles: the source and the language stand for tickers, labels for sentiment."""
    rating = table(spark, sf_dir, "labels")

    def insight(ticker, mood):
        return F.struct(mood.alias("sentiment"), F.lit("label").alias("sentiment_reasoning"), ticker.alias("ticker"))

    quality = F.when(F.col("quality") == 1, "positive").when(F.col("quality") == 0, "negative").otherwise("neutral")
    toxic = F.when(F.col("toxic") == 1, "negative").otherwise("neutral")
    source, lang = F.upper("source"), F.upper("lang")
    return table(spark, sf_dir, "documents").join(rating, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("description"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 300).cast("int")),
                      "yyyy-MM-dd").alias("published_utc"),
        F.array(source, lang).alias("tickers"),
        F.array(insight(source, quality), insight(lang, toxic)).alias("insights"))


_NEWS_SQL = (
    "SELECT CAST(d.doc_id AS VARCHAR) AS id, text, "
    "strftime(DATE '2024-01-01' + CAST(n_chars % 300 AS INTEGER), '%Y-%m-%d') AS published_utc, "
    "upper(source) AS source, upper(lang) AS lang, "
    "CASE quality WHEN 1 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'neutral' END AS q, "
    "CASE WHEN toxic = 1 THEN 'negative' ELSE 'neutral' END AS t "
    "FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")


@query("news_insights", sql(
    "SELECT id, published_utc, source AS ticker, q AS sentiment FROM n "
    "UNION ALL SELECT id, published_utc, lang, t FROM n", n=_NEWS_SQL))
def news_insights(spark, sf_dir):
    return portable(refdata.news_insights(news(spark, sf_dir)).drop("sentiment_reasoning"))


@query("news_by_ticker", sql(
    "SELECT id, published_utc, text AS description FROM n WHERE (source = 'EN' OR lang = 'EN') "
    "AND published_utc >= '2024-02-01' AND published_utc < '2024-08-01'", n=_NEWS_SQL))
def news_by_ticker(spark, sf_dir):
    return portable(refdata.list_news(
        news(spark, sf_dir), "EN", published_utc_gte="2024-02-01", published_utc_lt="2024-08-01").select(
        "id", "published_utc", "description"))


def order_books(spark, sf_dir):
    """Trades of a ticker and day as a book: whole prices are levels, users' groups are exchanges.

    The larger half of sizes are bids below the price, the others asks above it.
    """
    level = trades(spark, sf_dir).select(
        "ticker", F.to_date("ts").alias("updated"), (F.col("size") >= 50).alias("is_bid"),
        F.floor("price").cast("double").alias("price"),
        F.concat(F.lit("X"), F.col("user_id") % 8).alias("exchange"), "size")
    shares = level.groupBy("ticker", "updated", "is_bid", "price", "exchange").agg(
        F.sum("size").cast("double").alias("shares"))
    per_price = shares.groupBy("ticker", "updated", "is_bid", "price").agg(
        F.map_from_entries(F.collect_list(F.struct("exchange", "shares"))).alias("exchange_shares"))
    side = F.struct("price", "exchange_shares")
    return per_price.groupBy("ticker", "updated").agg(
        F.collect_list(F.when(F.col("is_bid"), side)).alias("bids"),
        F.collect_list(F.when(~F.col("is_bid"), side)).alias("asks"))


_LEVELS_SQL = (
    "SELECT ticker, CAST(ts AS DATE) AS updated, size >= 50 AS is_bid, floor(price) AS price, "
    "'X' || (user_id % 8) AS exchange, sum(size) AS shares FROM trades GROUP BY ALL")


@query("order_book", sql(
    f"SELECT ticker, {day('updated')} AS updated, {r('max(price) FILTER (WHERE is_bid)')} AS best_bid, "
    f"{r('min(price) FILTER (WHERE NOT is_bid)')} AS best_ask, "
    f"{r('min(price) FILTER (WHERE NOT is_bid) - max(price) FILTER (WHERE is_bid)')} AS spread, "
    f"{r('(min(price) FILTER (WHERE NOT is_bid) + max(price) FILTER (WHERE is_bid)) / 2')} AS midpoint, "
    "count(DISTINCT price) FILTER (WHERE is_bid) AS bid_levels, "
    "count(DISTINCT price) FILTER (WHERE NOT is_bid) AS ask_levels, "
    f"{r('coalesce(sum(shares) FILTER (WHERE is_bid), 0)')} AS bid_count, "
    f"{r('coalesce(sum(shares) FILTER (WHERE NOT is_bid), 0)')} AS ask_count FROM levels GROUP BY ticker, updated",
    "trades", levels=_LEVELS_SQL))
def order_book(spark, sf_dir):
    return portable(refdata.book_depth(order_books(spark, sf_dir)))


@query("order_book_levels", sql(
    f"SELECT ticker, {day('updated')} AS updated, CASE WHEN is_bid THEN 'bid' ELSE 'ask' END AS side, "
    f"{r('price')} AS price, exchange, {r('shares')} AS shares FROM levels", "trades", levels=_LEVELS_SQL))
def order_book_levels(spark, sf_dir):
    return portable(refdata.book_levels(order_books(spark, sf_dir)))


_STATEMENTS_SQL = (
    "SELECT CAST(o_custkey AS VARCHAR) AS cik, CAST(year(o_orderdate) AS VARCHAR) AS fiscal_year, "
    "sum(o_totalprice) AS revenues, max(o_totalprice) AS largest, CAST(count(*) AS DOUBLE) AS filings "
    "FROM orders GROUP BY 1, 2")
_LONG_SQL = " UNION ALL ".join(
    f"SELECT cik, fiscal_year, '{s}' AS statement, '{i}' AS item, '{u}' AS unit, {r(i)} AS value FROM f"
    for s, i, u in [("income_statement", "revenues", "USD"), ("income_statement", "largest", "USD"),
                    ("balance_sheet", "filings", "shares")])


@query("financials_long", sql(_LONG_SQL, f=_STATEMENTS_SQL))
def financials_long(spark, sf_dir):
    def point(column, unit):
        return F.struct(F.lit(column).alias("label"), F.lit(unit).alias("unit"), F.col(column).alias("value"))

    filings = table(spark, sf_dir, "orders").groupBy(
        F.col("o_custkey").cast("string").alias("cik"), F.year("o_orderdate").cast("string").alias("fiscal_year"),
    ).agg(F.sum("o_totalprice").alias("revenues"), F.max("o_totalprice").alias("largest"),
          F.count("*").cast("double").alias("filings"))
    text = F.to_json(F.struct(
        F.struct(point("revenues", "USD").alias("revenues"), point("largest", "USD").alias("largest"))
        .alias("income_statement"),
        F.struct(point("filings", "shares").alias("filings")).alias("balance_sheet")))
    found = refdata.financials_long(
        filings.select("cik", "fiscal_year", text.alias("json")), "json", ["cik", "fiscal_year"])
    return portable(found.select("cik", "fiscal_year", "statement", "item", "unit", "value"))


@query("currency_convert", sql(
    f"SELECT o_orderkey AS id, from_currency, {r('o_totalprice')} AS amount, {r('rate')} AS rate, "
    f"{r('round(o_totalprice * rate, 4)')} AS converted FROM (SELECT *, CASE o_orderstatus WHEN 'O' THEN 'CLICK' "
    "WHEN 'F' THEN 'VIEW' ELSE 'EUR' END AS from_currency FROM orders) o LEFT JOIN latest ON ticker = from_currency",
    "quotes", latest="SELECT ticker, arg_max((bid_price + ask_price) / 2, (ts, sequence)) AS rate FROM quotes GROUP BY 1"))
def currency_convert(spark, sf_dir):
    from barloom.workload.inputs import quotes
    rates = quotes(spark, sf_dir).select(
        F.concat("ticker", F.lit("/USD")).alias("pair"), F.col("bid_price").alias("bid"),
        F.col("ask_price").alias("ask"), F.col("ts").alias("timestamp"), "sequence")
    held = F.when(F.col("o_orderstatus") == "O", "CLICK").when(F.col("o_orderstatus") == "F", "VIEW").otherwise("EUR")
    amounts = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), held.alias("from_currency"), F.lit("USD").alias("to_currency"),
        F.col("o_totalprice").alias("amount"))
    return portable(refdata.convert_currency(amounts, rates, 4).select(
        "id", "from_currency", "amount", "rate", "converted"))


_PAGED_SQL = (
    f"SELECT ticker, {r('open')} AS open, {r('high')} AS high, {r('low')} AS low, {r('close')} AS close, "
    f"{r('volume')} AS volume, {r('vwap')} AS vwap, epoch_ms(window_start_et) AS timestamp, transactions FROM bars")


@query("json_pages", sql(_PAGED_SQL, "bars"))
def json_pages(spark, sf_dir):
    """Bars landed as response pages of one ticker and hour each, read back to flat rows."""
    from barloom.functions import clock
    row = F.struct(
        F.col("ticker").alias("T"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"),
        F.col("close").alias("c"), F.col("volume").alias("v"), F.col("vwap").alias("vw"),
        clock.epoch_ms(F.col("window_start_et")).alias("t"), F.col("transactions").alias("n"))
    pages = bars(spark, sf_dir).groupBy("ticker", F.date_format("window_start_et", "yyyyMMddHH")).agg(
        F.collect_list(F.to_json(row)).alias("found"))
    text = F.concat(F.lit('{"results":['), F.array_join("found", ","), F.lit(']}'))
    target = work_dir(spark, "pages")
    pages.select(text.alias("value")).write.text(target)
    return portable(landed.name_aggregate_keys(landed.read_pages(spark, target, multi_line=False)).drop("otc"))


@query("dataset_roundtrip", sql(
    f"SELECT id, {day('execution_date')} AS execution_date, {r('split_from')} AS split_from, "
    f"{r('split_to')} AS split_to, ticker FROM s", s=_SPLITS_SQL))
def dataset_roundtrip(spark, sf_dir):
    target = work_dir(spark, "splits")
    splits(spark, sf_dir).write.json(target)
    return portable(landed.read_dataset(spark, "splits", target))


@query("typed_pages", sql(
    f"SELECT ticker, count(*) AS n, {r('sum(split_to)')} AS shares FROM s GROUP BY ticker", s=_SPLITS_SQL))
def typed_pages(spark, sf_dir):
    """Splits landed as pages of 100 rows, read with the declared row layout."""
    target = work_dir(spark, "split-pages")
    source = splits(spark, sf_dir)
    page = F.call_function("div", F.monotonically_increasing_id(), F.lit(100).cast("bigint"))
    source.withColumn("_page", page).groupBy("_page").agg(
        F.collect_list(F.struct(*source.columns)).alias("results")).select("results").write.json(target)
    rows_back = landed.read_pages(spark, target, schemas.SPLIT, multi_line=False)
    return portable(rows_back.groupBy("ticker").agg(F.count("*").alias("n"), F.sum("split_to").alias("shares")))


@query("manifest_select",
       f"SELECT DISTINCT {day('o_orderdate')} || '.csv.gz' AS name, {day('o_orderdate')} AS file_date FROM orders "
       "WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1997-03-31' AND "
       "CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity > 49)")
def manifest_select(spark, sf_dir):
    """A listing with one file per order day; days of the largest shipments count as landed."""
    name = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(".csv.gz"))
    listing = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("file:/flat/minute/"), name).alias("path")).distinct()
    stored = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(".csv.gz")).alias("name"))
    return portable(select_files(listing, "1996-03-01", "1997-03-31", stored).drop("path"))


@query("path_parse",
       f"SELECT o_orderkey AS id, CAST(year(o_orderdate) AS BIGINT) AS year, o_orderpriority AS ticker, "
       f"{day('o_orderdate')} AS file_date FROM orders")
def path_parse(spark, sf_dir):
    escaped = F.replace("o_orderpriority", F.lit(" "), F.lit("%20"))
    path = F.concat(
        F.lit("file:/s/year="), F.year("o_orderdate"), F.lit("/ticker="), escaped, F.lit("/"),
        F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("-part-0.parquet"))
    listed = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), path.alias("path"))
    return portable(listed.select(
        "id", paths.partition_value(F.col("path"), "year").cast("int").alias("year"),
        paths.partition_value(F.col("path"), "ticker").alias("ticker"),
        paths.file_date(F.col("path")).alias("file_date")))
