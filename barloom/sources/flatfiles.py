"""Daily CSV flat files of raw bars."""

from __future__ import annotations

import logging
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import schemas
from barloom.errors import DataNotFound, DataValidationError
from barloom.functions import paths
from barloom.plans.barquery import parse_day
from barloom.session import path_exists

log = logging.getLogger(__name__)

LISTING = "path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY"


def read_raw_bars(spark: SparkSession, path: str | list[str], recursive: bool = False,
                  name_glob: str | None = None, tickers: list[str] | None = None) -> DataFrame:
    """Raw bars of one file, a glob, a list of paths or a folder tree.

    Columns are taken by header name. Every value is read as text and cast
    safely: whole numbers exactly, a volume such as ``1000.5`` becomes 1000, and
    what is no number in the type's range (``NaN``, ``1e30``) becomes NULL. Files whose header differs
    from the first one's are refused rather than bound by position.
    """
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    text = _load(reader, path)
    require_columns(text, schemas.RAW_BAR_COLUMNS)
    typed = text.select(
        "ticker", _long("volume"), *[_double(c) for c in ("open", "close", "high", "low")],
        _long("window_start"), _long("transactions"),
    )
    return typed.filter(F.col("ticker").isin(tickers)) if tickers else typed


def read_raw_bars_declared(spark: SparkSession, path: str | list[str],
                           schema: str = schemas.RAW_BAR) -> DataFrame:
    """Raw bars read with a declared layout, which the file header must match."""
    return _load(spark.read.schema(schema).option("header", True).option("enforceSchema", False), path)


def convert_flat_file(spark: SparkSession, source: str, target: str) -> DataFrame:
    """One CSV(.gz) file to Parquet, values unchanged."""
    _load(spark.read.option("header", True).option("inferSchema", True), source) \
        .write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise DataValidationError(f"the file header lacks {', '.join(missing)}")


def list_files(spark: SparkSession, root: str, name_glob: str | None = None) -> DataFrame:
    """One row per file below ``root``: path, length, modified. No file is opened."""
    reader = spark.read.format("binaryFile").schema(LISTING).option("recursiveFileLookup", True)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if not path_exists(spark, root):
        raise DataNotFound(f"no folder {root}")
    return reader.load(root).select("path", "length", F.col("modificationTime").alias("modified"))


def manifest(spark: SparkSession, root: str, start: str | date, end: str | date | None = None,
             landed: DataFrame | None = None, name_glob: str = "*.csv.gz") -> DataFrame:
    """Files below ``root`` named by a date within ``[start, end]`` and not yet landed."""
    return select_files(list_files(spark, root, name_glob), start, end, landed)


def select_files(listing: DataFrame, start: str | date, end: str | date | None = None,
                 landed: DataFrame | None = None) -> DataFrame:
    """``path, name, file_date`` of listed files dated within ``[start, end]``.

    ``landed`` holds a column ``name`` with the file names already present.
    """
    last = parse_day(end) if end is not None else date.today()
    files = listing.select(
        "path", paths.file_name(F.col("path")).alias("name"),
        paths.file_date(F.col("path")).alias("file_date"),
    ).filter(F.col("file_date").between(F.lit(parse_day(start)), F.lit(last)))
    if landed is None:
        return files
    return files.join(landed.select("name").distinct(), "name", "left_anti").select(files.columns)


def _load(reader, path):
    try:
        return reader.csv(path)
    except AnalysisException as error:
        raise _not_found(error, path) from error


def _not_found(error: AnalysisException, path) -> Exception:
    if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
        log.warning("no files at %s", path)
        return DataNotFound(f"no files at {path}")
    return error


def _double(name: str):
    return F.col(name).try_cast("double").alias(name)


def _long(name: str):
    """Whole numbers keep every digit; only other spellings go through double."""
    text = F.col(name)
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint")).alias(name)
