"""Operators over reference data: filters, look-ups and nested columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import schemas
from barloom.errors import DataValidationError
from barloom.functions.ratios import midpoint
from barloom.operators.rows import latest_row, sorted_limit

_COMPARISONS = {
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "any_of": lambda c, v: c.isin(list(v)),
}


def compare_filter(df: DataFrame, **criteria) -> DataFrame:
    """Keep rows for which every criterion holds.

    ``field=value`` is equality; ``field_lt``, ``_lte``, ``_gt``, ``_gte`` and
    ``_any_of`` compare. None criteria are ignored.
    """
    out = df
    for name, value in criteria.items():
        if value is None:
            continue
        out = out.filter(_criterion(df, name, value))
    return out


def _criterion(df: DataFrame, name: str, value) -> Column:
    if name in df.columns:
        return F.col(name) == value
    for ext in sorted(_COMPARISONS, key=len, reverse=True):
        column = name.removesuffix(f"_{ext}")
        if column != name and column in df.columns:
            return _COMPARISONS[ext](F.col(column), value)
    raise DataValidationError(f"no column for filter {name!r}")


def _listed(df: DataFrame, sort, order, limit) -> DataFrame:
    """Sorted and cut; equal sort keys are ordered by the other plain columns, so that a cut is stable."""
    if sort is None and limit is None:
        return df
    first = sort or df.columns[0]
    plain = [f.name for f in df.schema if isinstance(f.dataType, T.AtomicType) and f.name != first]
    return sorted_limit(df, first, order, limit, plain)


def list_splits(splits: DataFrame, reverse_split: bool | None = None, sort: str | None = None,
                order: str = "asc", limit: int | None = None, **criteria) -> DataFrame:
    """Splits by any comparison; a reverse split has ``split_from > split_to``."""
    out = compare_filter(splits, **criteria)
    if reverse_split is not None:
        is_reverse = F.col("split_from") > F.col("split_to")
        out = out.filter(is_reverse if reverse_split else ~is_reverse)
    return _listed(out, sort, order, limit)


def list_dividends(dividends: DataFrame, sort: str | None = None, order: str = "asc",
                   limit: int | None = None, **criteria) -> DataFrame:
    return _listed(compare_filter(dividends, **criteria), sort, order, limit)


def list_tickers(directory: DataFrame, search: str | None = None, sort: str | None = None,
                 order: str = "asc", limit: int | None = None, **criteria) -> DataFrame:
    """Ticker directory; ``search`` matches part of the ticker or name, ignoring case."""
    out = compare_filter(directory, **criteria)
    if search:
        text = search.lower()
        out = out.filter(F.contains(F.lower("ticker"), F.lit(text)) | F.contains(F.lower("name"), F.lit(text)))
    return _listed(out, sort, order, limit)


def list_news(news: DataFrame, ticker: str | None = None, sort: str | None = None, order: str = "asc",
              limit: int | None = None, **criteria) -> DataFrame:
    """Articles that mention ``ticker``, by publish time."""
    out = compare_filter(news, **criteria)
    if ticker:
        out = out.filter(F.array_contains("tickers", ticker))
    return _listed(out, sort, order, limit)


def list_options_contracts(contracts: DataFrame, as_of=None, expired: bool | None = None,
                           sort: str | None = None, order: str = "asc", limit: int | None = None,
                           **criteria) -> DataFrame:
    """Contracts by any comparison; expired means expiration before ``as_of`` (today if not given)."""
    out = compare_filter(contracts, **criteria)
    if expired is not None:
        day = F.current_date() if as_of is None else F.lit(as_of).cast("date")
        is_expired = F.col("expiration_date") < day
        out = out.filter(is_expired if expired else ~is_expired)
    return _listed(out, sort, order, limit)


def list_financials(filings: DataFrame, company_name_search: str | None = None, sort: str | None = None,
                    order: str = "asc", limit: int | None = None, **criteria) -> DataFrame:
    """Filings; ``company_name_search`` matches part of the company name, ignoring case."""
    out = compare_filter(filings, **criteria)
    if company_name_search:
        out = out.filter(F.contains(F.lower("company_name"), F.lit(company_name_search.lower())))
    return _listed(out, sort, order, limit)


def list_ipos(ipos: DataFrame, sort: str = "listing_date", order: str = "desc",
              limit: int | None = None, **criteria) -> DataFrame:
    return _listed(compare_filter(ipos, **criteria), sort, order, limit)


def without_otc(df: DataFrame) -> DataFrame:
    return df.filter(~F.coalesce(F.col("otc"), F.lit(False)))


def ticks_between(ticks: DataFrame, ticker: str, time: str = "sip_timestamp", order: str = "asc",
                  limit: int | None = None, **criteria) -> DataFrame:
    """Trades or quotes of one ticker by nanosecond time, sorted, limited.

    The sort key is unique with the sequence number, so a limit is stable.
    """
    out = compare_filter(ticks.filter(F.col("ticker") == ticker), **criteria)
    return sorted_limit(out, time, order, limit, tie=["sequence_number"])


def with_condition_names(trades: DataFrame, conditions: DataFrame) -> DataFrame:
    """Add ``condition_names`` and whether all conditions update high and low.

    Codes keep their order; unknown codes give a NULL name and do not block
    updates. Names are looked up once per distinct list of codes, whichever
    trades have it, so trades without a key, or with a repeated one, keep their rows.
    """
    rule = F.col("update_rules.consolidated.updates_high_low")
    codes = conditions.groupBy("id").agg(
        F.min("name").alias("name"), F.min(F.coalesce(rule, F.lit(True))).alias("updates_high_low"))
    lists = trades.select(F.col("conditions").alias("_list")).where("_list IS NOT NULL").distinct()
    named = lists.select("_list", F.posexplode_outer("_list").alias("_at", "id")).join(codes, "id", "left")
    per_list = named.groupBy("_list").agg(
        F.array_sort(F.collect_list(F.struct("_at", "name"))).alias("_names"),
        F.min(F.coalesce("updates_high_low", F.lit(True))).alias("updates_high_low"))
    joined = trades.join(per_list, F.col("conditions") == F.col("_list"), "left")
    known = F.filter("_names", lambda n: n["_at"].isNotNull())
    return joined.select(*[trades[c] for c in trades.columns], F.transform(known, lambda n: n["name"]).alias("condition_names"),
                         "updates_high_low")


def with_lookup(facts: DataFrame, lookup: DataFrame, on: list[str]) -> DataFrame:
    """Left look-up in a reference table with one row per key, such as exchanges or ticker types."""
    return facts.join(lookup, on, "left")


def related_companies(related: DataFrame, directory: DataFrame) -> DataFrame:
    """Related tickers with the name each has in the directory."""
    names = directory.select(F.col("ticker").alias("related"), F.col("name").alias("related_name"))
    return with_lookup(related, names, ["related"])


def book_depth(books: DataFrame) -> DataFrame:
    """Best prices, spread and share depth on both sides of each order book."""

    def shares(side: str) -> Column:
        return F.aggregate(side, F.lit(0.0), lambda total, level: total + F.aggregate(
            F.map_values(level["exchange_shares"]), F.lit(0.0), lambda t, s: t + s))

    best_bid = F.array_max(F.transform("bids", lambda level: level["price"]))
    best_ask = F.array_min(F.transform("asks", lambda level: level["price"]))
    return books.select(
        "ticker", "updated", best_bid.alias("best_bid"), best_ask.alias("best_ask"),
        (best_ask - best_bid).alias("spread"), midpoint(best_bid, best_ask).alias("midpoint"),
        F.size("bids").cast("bigint").alias("bid_levels"), F.size("asks").cast("bigint").alias("ask_levels"),
        shares("bids").alias("bid_count"), shares("asks").alias("ask_count"),
    )


def book_levels(books: DataFrame) -> DataFrame:
    """One row per ticker, side, price and exchange of each order book."""

    def side(name: str, label: str) -> DataFrame:
        return books.select("ticker", "updated", F.lit(label).alias("side"), F.inline(name)).select(
            "ticker", "updated", "side", "price", F.explode("exchange_shares").alias("exchange", "shares"))

    return side("bids", "bid").unionByName(side("asks", "ask"))


def news_insights(news: DataFrame) -> DataFrame:
    """One row per article, ticker and sentiment."""
    return news.select("id", "published_utc", F.inline("insights")).select(
        "id", "published_utc", "ticker", "sentiment", "sentiment_reasoning")


def financials_long(filings: DataFrame, json_column: str | None = None,
                    carry: list[str] | None = None) -> DataFrame:
    """Statements to one row per statement and item, from the nested column or its JSON text."""
    source = F.from_json(json_column, schemas.STATEMENTS) if json_column else F.col("financials")
    carry = carry if carry is not None else ["cik", "company_name", "fiscal_period", "fiscal_year", "filing_date"]
    statements = filings.select(*carry, F.explode(source).alias("statement", "_items"))
    items = statements.select(*carry, "statement", F.explode("_items").alias("item", "_point"))
    return items.select(*carry, "statement", "item", "_point.label", "_point.unit", "_point.value", "_point.order")


def convert_currency(amounts: DataFrame, quotes: DataFrame, precision: int = 2) -> DataFrame:
    """Convert ``amount`` of ``from_currency`` to ``to_currency`` at the latest mid rate of the pair.

    ``quotes`` holds ``pair`` (``FROM/TO``), ``bid``, ``ask`` and the order columns
    ``timestamp, sequence``. A pair without a quote gives NULL.
    """
    if precision not in range(5):
        raise DataValidationError("precision is 0 to 4 digits")
    latest = latest_row(quotes, ["pair"], ["timestamp", "sequence"]).select(
        "pair", midpoint(F.col("bid"), F.col("ask")).alias("rate"))
    keyed = amounts.withColumn("pair", F.concat_ws("/", "from_currency", "to_currency"))
    return keyed.join(latest, "pair", "left").withColumn(
        "converted", F.round(F.col("amount") * F.col("rate"), precision))


def market_midpoint(quotes: DataFrame) -> DataFrame:
    return quotes.withColumn("midpoint", midpoint(F.col("bid_price"), F.col("ask_price")))

