"""Selection of bars by ticker, year, date range and columns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.errors import DataNotFound, DataValidationError, QueryError

TIME_COLUMN = "window_start_et"
# What Spark writes as %XX in the name of a partition folder, and the folder of null and empty values.
ESCAPED = {*map(chr, range(1, 32)), "\x7f", *"\"#%'*/:=?\\{[]^"}
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def parse_day(value: str | date | datetime) -> date:
    """Calendar day of a date, datetime, ``YYYY-MM-DD`` or ``YYYY-MM-DD HH:MM:SS``."""
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    if not isinstance(value, str):
        raise DataValidationError(f"not a date: {value!r}")
    for pattern in ("%Y-%m-%d", "%Y-%m-%d %H:%M:%S"):
        try:
            return datetime.strptime(value, pattern).date()
        except ValueError:
            pass
    raise DataValidationError(f"not a date: {value!r}")


def partition_folder(key: str, value: str | int | None) -> str:
    """Name of the folder ``key=value``, escaped as the writer does."""
    text = "" if value is None else str(value)
    return f"{key}={''.join(f'%{ord(c):02X}' if c in ESCAPED else c for c in text) or NO_VALUE}"


def _as_list(value) -> list:
    return [value] if isinstance(value, (str, int)) else list(value)


@dataclass(frozen=True)
class BarQuery:
    """An immutable bar selection; every ``with_*`` call returns a changed copy.

    Both ends of the date range are inclusive market-time days. A year list and
    a date range are both honoured, so their intersection is read.
    """

    tickers: list[str] | None = None
    years: list[int] | None = None
    start: date | None = None
    end: date | None = None
    columns: list[str] | None = field(default=None)

    def with_tickers(self, tickers: str | Iterable[str], exact_case: bool = False) -> BarQuery:
        names = _as_list(tickers)
        return replace(self, tickers=names if exact_case else [t.upper() for t in names])

    def with_years(self, years: int | Iterable[int]) -> BarQuery:
        return replace(self, years=[int(y) for y in _as_list(years)])

    def with_date_range(self, start, end) -> BarQuery:
        first, last = parse_day(start), parse_day(end)
        if first > last:
            raise DataValidationError(f"start date {first} is after end date {last}")
        return replace(self, start=first, end=last)

    def with_columns(self, columns: Iterable[str]) -> BarQuery:
        return replace(self, columns=list(columns))

    @classmethod
    def build(cls, tickers=None, years=None, start_date=None, end_date=None, columns=None,
              exact_case: bool = False, default_year: int | None = None) -> BarQuery:
        query = cls()
        if tickers:
            query = query.with_tickers(tickers, exact_case)
        if years:
            query = query.with_years(years)
        if (start_date is None) != (end_date is None):
            raise DataValidationError("give both ends of the date range")
        if start_date is not None:
            query = query.with_date_range(start_date, end_date)
        if columns:
            query = query.with_columns(columns)
        if default_year is not None and query.partition_years() is None:
            query = query.with_years(default_year)
        return query

    def partition_years(self) -> list[int] | None:
        """Years that can hold selected rows; None means all."""
        in_range = None
        if self.start is not None:
            in_range = list(range(self.start.year, self.end.year + 1))
        if self.years is None:
            return in_range
        if in_range is None:
            return self.years
        return [y for y in self.years if y in in_range]

    def predicates(self) -> list[Column]:
        """Plain comparisons, so that partitions and row groups can be skipped."""
        found = []
        years = self.partition_years()
        if years is not None:
            found.append(F.col("year").isin(years) if years else F.lit(False))
        if self.tickers is not None:
            found.append(F.col("ticker").isin(self.tickers))
        if self.start is not None:
            found.append(F.col(TIME_COLUMN) >= _midnight(self.start))
            found.append(F.col(TIME_COLUMN) < _midnight(self.end + timedelta(days=1)))
        return found

    def apply(self, bars: DataFrame, ordered: bool = False, require_rows: bool = False) -> DataFrame:
        if self.start is not None and TIME_COLUMN not in bars.columns:
            raise DataValidationError(f"a date range needs the column {TIME_COLUMN}")
        self.check_columns(bars)
        out = bars
        for predicate in self.predicates():
            out = out.filter(predicate)
        if ordered:
            out = out.orderBy(TIME_COLUMN, "ticker")
        if self.columns:
            out = out.select(*self.columns)
        if require_rows and out.isEmpty():
            raise DataNotFound(f"no bars for {self}")
        return out

    def check_columns(self, bars: DataFrame) -> None:
        missing = sorted(set(self.columns or []) - set(bars.columns))
        if missing:
            raise DataValidationError(f"the bars have no column {', '.join(missing)}")

    def partition_paths(self, root: str) -> list[str]:
        """Folders of the store that can hold selected rows; an unescaped ``*`` stands for all."""
        years = self.partition_years()
        year_part = ["year=*"] if years is None else [partition_folder("year", y) for y in years]
        ticker_part = ["ticker=*"] if self.tickers is None else [partition_folder("ticker", t) for t in self.tickers]
        return [f"{root.rstrip('/')}/{y}/{t}" for y in year_part for t in ticker_part]

    def to_sql(self, view: str, ordered: bool = False) -> tuple[str, dict]:
        """Spark SQL text over ``view`` with named parameters, and their values."""
        args: dict = {}
        where = []
        years = self.partition_years()
        if years is not None:
            where.append(_membership("year", "y", years, args))
        if self.tickers is not None:
            where.append(_membership("ticker", "t", self.tickers, args))
        if self.start is not None:
            args["from_day"] = self.start
            args["to_day"] = self.end + timedelta(days=1)
            where.append(f"{TIME_COLUMN} >= CAST(:from_day AS TIMESTAMP_NTZ)")
            where.append(f"{TIME_COLUMN} < CAST(:to_day AS TIMESTAMP_NTZ)")
        text = f"SELECT {', '.join(f'`{c}`' for c in self.columns) if self.columns else '*'} FROM {view}"
        if where:
            text += " WHERE " + " AND ".join(where)
        if ordered:
            text += f" ORDER BY {TIME_COLUMN}, ticker"
        return text, args

    def run_sql(self, spark: SparkSession, view: str, ordered: bool = False) -> DataFrame:
        text, args = self.to_sql(view, ordered)
        try:
            return spark.sql(text, args=args)
        except Exception as error:
            raise QueryError(f"{text}: {error}") from error


def _midnight(day: date) -> Column:
    return F.lit(day).cast("timestamp_ntz")


def _membership(column: str, prefix: str, values: list, args: dict) -> str:
    if not values:
        return "false"
    names = []
    for position, value in enumerate(values):
        args[f"{prefix}{position}"] = value
        names.append(f":{prefix}{position}")
    return f"{column} IN ({', '.join(names)})"
