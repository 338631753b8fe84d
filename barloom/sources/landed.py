"""Reference data landed as JSON pages or CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom import schemas
from barloom.errors import ConfigurationError


def read_pages(spark: SparkSession, path: str, row_schema: str | None = None,
               result_key: str = "results", multi_line: bool = True) -> DataFrame:
    """Rows of landed response pages with the page file and the place in the page.

    A page is one JSON document with an array of rows and, except the last, a
    pointer to the next page. Pages without the array give no rows. Without a row
    layout, each row is kept as JSON text in the column ``json``.
    """
    kind = f"STRUCT<{row_schema}>" if row_schema else "STRING"
    pages = spark.read.schema(f"`{result_key}` ARRAY<{kind}>, next_url STRING") \
        .option("multiLine", multi_line).json(path)
    rows = pages.select(
        F.col("_metadata.file_path").alias("page"), F.posexplode(result_key).alias("page_row", "json"))
    return rows.select("page", "page_row", "json.*") if row_schema else rows


def read_dataset(spark: SparkSession, name: str, path: str, fmt: str = "json") -> DataFrame:
    """A landed dataset with its declared layout (JSON lines, CSV with header, or Parquet)."""
    if name not in schemas.DATASETS:
        raise ConfigurationError(f"unknown dataset {name}; known: {sorted(schemas.DATASETS)}")
    reader = spark.read.schema(schemas.DATASETS[name])
    if fmt == "csv":
        reader = reader.option("header", True).option("enforceSchema", False)
    return reader.format(fmt).load(path)


def name_aggregate_keys(raw: DataFrame) -> DataFrame:
    """Landed aggregate rows with short keys to named columns; absent keys give NULL."""
    # Case matters: T is the ticker and t the time, so rows arrive as one JSON text column.
    parsed = F.from_json("json", "MAP<STRING, STRING>")
    return raw.select(*[
        parsed.getItem(key).cast(kind).alias(name)
        for key, (name, kind) in schemas.AGGREGATE_KEYS.items()
    ])


