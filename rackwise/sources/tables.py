"""Reading and writing the shop tables, ad-hoc SQL over them, CSV export."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from threading import Lock
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StringType, StructField, StructType

from rackwise.sources.schema import KEYS, SCHEMAS

# What the CSV reader puts for a bare gap; a text no cell holds, so that "" stays an empty string.
_GAP = "\u0001"

_VIEWS = Lock()

# The tables that are laid out by month, and of which date.
DATED = {"sales": "date", "items": "listed_at"}
MONTH = "month_of_row"


@dataclass(frozen=True)
class Tables:
    consignors: DataFrame
    items: DataFrame
    sales: DataFrame

    def named(self) -> dict[str, DataFrame]:
        return {"consignors": self.consignors, "items": self.items, "sales": self.sales}


def load_tables(
    spark: SparkSession, folder: str, fmt: str = "parquet", multi_line: bool = True,
    sold: tuple[dt.date, dt.date] | None = None, listed: tuple[dt.date, dt.date] | None = None,
) -> Tables:
    """Read ``folder/<table>`` for the three tables with their fixed schemas.

    ``parquet`` holds typed dates. ``csv`` (with header) holds dates as text: a malformed date
    becomes NULL. The schema is given, so nothing is inferred from the data. Notes may hold line
    breaks, so a CSV file is read by one task; ``multi_line=False`` splits files whose cells have none.

    Parquet tables lie in folders by the month of sale and of listing. ``sold`` and ``listed``, first
    and last day, leave out the sales and items of other months, and those without a date, without
    opening their files; a report on a period still filters by day.
    """
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown table format {fmt!r}")
    periods = {"sales": sold, "items": listed}
    return Tables(**{name: load_table(spark, folder, name, fmt, multi_line, periods.get(name)) for name in SCHEMAS})


def load_table(
    spark: SparkSession, folder: str, name: str, fmt: str = "parquet", multi_line: bool = True,
    period: tuple[dt.date, dt.date] | None = None,
) -> DataFrame:
    """One of the tables; see :func:`load_tables`."""
    path, schema = f"{folder}/{name}", SCHEMAS[name]
    if fmt == "csv":
        return _read_csv(spark, path, schema, multi_line)
    if name not in DATED:
        return spark.read.schema(schema).parquet(path)
    stored = spark.read.schema(StructType([*schema.fields, StructField(MONTH, StringType())])).parquet(path)
    if period is not None:
        stored = stored.filter((F.col(MONTH) >= f"{period[0]:%Y-%m}") & (F.col(MONTH) <= f"{period[1]:%Y-%m}"))
    return stored.drop(MONTH)


def _read_csv(spark: SparkSession, path: str, schema: StructType, multi_line: bool) -> DataFrame:
    text_dates = ", ".join(
        f"`{f.name}` {'string' if isinstance(f.dataType, DateType) else f.dataType.simpleString()}" for f in schema
    )
    # Quoted "" is an empty string, a bare gap is NULL: both occur in the tables and differ.
    raw = (
        spark.read.schema(text_dates).option("header", True).option("multiLine", multi_line)
        .option("nullValue", _GAP).option("emptyValue", "").option("escape", '"').csv(path)
    )
    return raw.select([
        F.try_to_timestamp(F.col(f.name), F.lit("yyyy-MM-dd")).cast("date").alias(f.name)
        if isinstance(f.dataType, DateType) else F.col(f.name)
        for f in schema
    ])


def write_tables(tables: Tables, folder: str, fmt: str = "parquet") -> None:
    """Write each table to a fresh folder in the form :func:`load_tables` reads."""
    for name, df in tables.named().items():
        write_table(df, folder, name, fmt)


def write_table(df: DataFrame, folder: str, name: str, fmt: str = "parquet") -> None:
    path = f"{folder}/{name}"
    if fmt == "csv":
        write_csv(df, path)
    elif name in DATED:
        dated = by_month(df.withColumn(MONTH, F.date_format(DATED[name], "yyyy-MM")))
        key = KEYS[name]
        # A look-up by key skips row groups whose Bloom filter rules the key out.
        blooms = {f"parquet.bloom.filter.enabled#{key}": "true", "parquet.bloom.filter.adaptive.enabled": "true"}
        dated.write.mode("errorifexists").options(**blooms).partitionBy(MONTH).parquet(path)
    else:
        df.write.mode("errorifexists").parquet(path)


def by_month(rows: DataFrame) -> DataFrame:
    """``rows`` dealt by ``MONTH`` for a write to month folders: a task writes to few months, a busy month is cut among many tasks.

    The cuts follow from the sizes that the shuffle has met. Ranges of dates would need a sample first, and for it every row computed twice.
    """
    return rows.hint("rebalance", MONTH)


def save_bucketed(tables: Tables, folder: str, prefix: str, buckets: int) -> None:
    """Store the tables as ``<prefix>_<table>`` in the session's catalog, files below ``folder``.

    Items and sales are bucketed and sorted by SKU with the same count, so every report that joins
    or folds them by SKU runs without shuffling either. Pick ``buckets`` so that one bucket of
    items fits a task. Each SKU's sales lie in one bucket: a SKU holding a large share of all sales
    is better left to :func:`write_tables`, where a fold before the shuffle absorbs it.
    """
    for name, df in tables.named().items():
        by_sku = "sku" in df.columns
        # One task per bucket, so a bucket is one sorted file.
        writer = (df.repartition(buckets, "sku") if by_sku else df).write.mode("errorifexists").format("parquet")
        if by_sku:
            writer = writer.bucketBy(buckets, "sku").sortBy("sku")
        writer.option("path", f"{folder}/{name}").saveAsTable(f"{prefix}_{name}")


def bucketed_tables(spark: SparkSession, prefix: str) -> Tables:
    return Tables(**{name: spark.table(f"{prefix}_{name}") for name in SCHEMAS})


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line, UTF-8, no index column. One file per partition, so nothing funnels."""
    (
        df.write.mode("errorifexists").option("header", True).option("encoding", "UTF-8")
        .option("emptyValue", '""').option("escape", '"').option("dateFormat", "yyyy-MM-dd").csv(path)
    )


def run_sql(spark: SparkSession, tables: Tables, sql: str, args: Mapping[str, Any] | Sequence[Any] = ()) -> DataFrame:
    """Run SQL over the views ``consignors``, ``items``, ``sales``; ``?`` or ``:name`` parameters.

    The views exist while the statement is analysed, one call at a time; then the session's own views
    of these names are back.
    """
    with _VIEWS:
        own = {v.name: spark.table(v.name) for name in tables.named() for v in spark.catalog.listTables(pattern=name) if v.isTemporary}
        try:
            for name, df in tables.named().items():
                df.createOrReplaceTempView(name)
            return spark.sql(sql, args=dict(args) if isinstance(args, Mapping) else list(args))
        finally:
            for name in tables.named():
                if name in own:
                    own[name].createOrReplaceTempView(name)
                else:
                    spark.catalog.dropTempView(name)
