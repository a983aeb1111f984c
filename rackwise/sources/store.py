"""Tables in month folders, changed folder by folder, with a directory that tells which months hold a key.

``create_store`` lays the tables out as :func:`write_tables` does, and beside ``items`` and ``sales`` a
directory of (key, month), itself in folders by a hash of the key. A change reads the directory's
folders of its keys, then the months found there and the months it puts rows into; no other file is
opened or written. Months are few, so lists of them are kept on the driver.

A change writes its months to a folder of its own in the store, then the directory, adding to it only,
then moves the months into their places. A run that dies in between leaves at most that folder, which
nobody reads, and entries for months that don't hold the key, which cost a folder read and change
nothing. Two changes to one table must not run at the same time.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from rackwise.functions.columns import in_stock
from rackwise.functions.fixed_values import MARKDOWN_AGES
from rackwise.operators.listings import newest_first
from rackwise.operators.markdown import apply_markdowns
from rackwise.operators.merge import delete_keys, folded, upsert_folded
from rackwise.sources.schema import KEYS, SCHEMAS
from rackwise.sources.tables import DATED, MONTH, Tables, by_month, write_table
from rackwise.sources.workspace import stored

KEY_BUCKETS = 64
# So many keys are written into the filter, where Parquet's own Bloom filters skip row groups; more are joined.
KEYS_IN_FILTER = 500
_BUCKET = "key_bucket"
_NO_MONTH = "__HIVE_DEFAULT_PARTITION__"

Month = str | None


@dataclass(frozen=True)
class Touched:
    """The months that a change read and wrote, and those of them it left without rows."""

    months: list[Month] = field(default_factory=list)
    emptied: list[Month] = field(default_factory=list)


def create_store(tables: Tables, folder: str, buckets: int = KEY_BUCKETS) -> None:
    """Write the three tables and the key directories to a fresh folder."""
    for name, df in tables.named().items():
        write_table(df, folder, name)
    spark = tables.items.sparkSession
    for name in DATED:
        keys = _table(spark, folder, name).select(F.col(KEYS[name]).alias("key"), MONTH)
        _with_bucket(keys.where("key is not null"), buckets).repartition(_BUCKET).write.mode("errorifexists").partitionBy(_BUCKET).parquet(_directory(folder, name))
        # The number of folders, as a table of one row: every reader and writer needs the same one.
        spark.range(1).select(F.lit(buckets).alias("buckets")).write.mode("errorifexists").parquet(f"{_directory(folder, name)}_buckets")


def store_months(spark: SparkSession, folder: str, name: str) -> list[Month]:
    """The months that have files, newest first, rows without a date last. Files are listed, not opened."""
    return _ordered({_month_in(file) for file in _table(spark, folder, name).inputFiles()})


def load_months(spark: SparkSession, folder: str, name: str, months: Sequence[Month]) -> DataFrame:
    """The rows of these months alone."""
    return _table(spark, folder, name).where(among(MONTH, months)).drop(MONTH)


def months_of_keys(spark: SparkSession, folder: str, name: str, keys: DataFrame) -> list[Month]:
    """The months that may hold the keys (column ``key``), from the directory's folders of these keys."""
    return _ordered(_months_in(_entries(spark, folder, name, keys), keys))


def upsert_by_month(
    spark: SparkSession, folder: str, name: str, changes: DataFrame, update_cols: Sequence[str] | None = None,
    order_by: Sequence[str] = (), defaults: Mapping[str, Any] | None = None,
) -> Touched:
    """:func:`merge.upsert` in place: only months that hold a changed key or receive a row are read and written.

    A changed date moves a row to its new month. The result is that of the upsert of the whole table.
    A change without a key fails the run. No changes: nothing is read or written.
    """
    key, date = KEYS[name], DATED[name]
    batch = stored(folded(changes, key, order_by), "changes")
    keys = batch.select(F.col(key).alias("key"))
    entries = _entries(spark, folder, name, keys)
    months = _months_in(entries, keys)
    if date in batch.columns:
        months |= {row[0] for row in batch.select(month_of(F.col(date))).distinct().collect()}
    elif not keys.join(entries, "key", "left_anti").isEmpty():
        months.add(None)  # new rows without a date
    if not months:
        return Touched()
    merged = upsert_folded(load_months(spark, folder, name, [*months]), batch, key, update_cols, defaults)
    staged = _staged(by_month(merged.withColumn(MONTH, month_of(F.col(date)))), folder, name, MONTH)
    if date in batch.columns and (update_cols is None or date in update_cols):
        moved = batch.select(F.col(key).alias("key"), month_of(F.col(date).cast("date")).alias(MONTH))  # all rows of a key take its date
    else:
        moved = _table(spark, folder, name, staged).join(keys, F.col(key) == F.col("key"), "left_semi").select(F.col(key).alias("key"), MONTH)
    _add_entries(spark, folder, name, entries, moved)
    return _put_months(spark, staged, f"{folder}/{name}", months)


def delete_by_month(spark: SparkSession, folder: str, name: str, keys: DataFrame) -> Touched:
    """:func:`merge.delete_keys` in place, over the months that may hold the keys (column named as the table's key)."""
    key = KEYS[name]
    batch = stored(keys.select(key).where(F.col(key).isNotNull()).distinct(), "deleted-keys")
    months = {*months_of_keys(spark, folder, name, batch.select(F.col(key).alias("key")))}
    if not months:
        return Touched()
    kept = delete_keys(_table(spark, folder, name).where(among(MONTH, [*months])), batch, key)
    return _put_months(spark, _staged(by_month(kept), folder, name, MONTH), f"{folder}/{name}", months)


def rows_by_key(spark: SparkSession, folder: str, name: str, keys: DataFrame, most: int = KEYS_IN_FILTER) -> DataFrame:
    """The rows of the keys (column named as the table's key), from the months that hold them.

    Up to ``most`` keys become a filter that Parquet checks against each row group's range and Bloom filter
    before reading it; a longer list meets these months in a join.
    """
    key = KEYS[name]
    distinct = keys.select(key).where(F.col(key).isNotNull()).distinct()
    months = load_months(spark, folder, name, months_of_keys(spark, folder, name, distinct.select(F.col(key).alias("key"))))
    some = distinct.limit(most + 1).collect()
    if len(some) <= most:
        return months.where(F.col(key).isin([row[0] for row in some]))
    return months.join(distinct, key, "left_semi").select(*SCHEMAS[name].names)


def newest_items(spark: SparkSession, folder: str, n: int, wanted: str = "true") -> DataFrame:
    """Items in stock that ``wanted`` (a condition in SQL) allows, holding at least the ``n`` newest of them (ties by SKU), or all if they are fewer.

    Months are visited newest first, twice as many each time, until ``n`` rows are certain: all older
    months hold older rows. Where they are never reached, this ends at all months.
    """
    months = store_months(spark, folder, "items")
    fits, at = in_stock() & F.expr(wanted), 1
    while True:
        found = load_months(spark, folder, "items", months[:at]).where(fits)
        if at >= len(months) or found.limit(n).count() >= n:
            return found
        at *= 2


def newest_tables(spark: SparkSession, folder: str, n: int, wanted: str = "true") -> Tables:
    """The store's tables with the items that hold the ``n`` newest ones, for the reports that list the newest items."""
    consignors = spark.read.schema(SCHEMAS["consignors"]).parquet(f"{folder}/consignors")
    return Tables(consignors, newest_items(spark, folder, n, wanted), _table(spark, folder, "sales").drop(MONTH))


def months_due(last_run: dt.date, as_of: dt.date) -> list[str]:
    """The months of listing in which an item can have passed an age of the schedule since ``last_run``."""
    months = set()
    for age in MARKDOWN_AGES.values():
        day = last_run - dt.timedelta(days=age)
        while day < as_of - dt.timedelta(days=age):
            months.add(f"{day:%Y-%m}")
            day = min(day + dt.timedelta(days=27), as_of - dt.timedelta(days=age))
        if last_run < as_of:
            months.add(f"{as_of - dt.timedelta(days=age + 1):%Y-%m}")
    return sorted(months)


def markdown_by_month(spark: SparkSession, folder: str, last_run: dt.date, as_of: dt.date, changed: DataFrame | None = None) -> Touched:
    """Raise the stages that are due since ``last_run``: :func:`apply_markdowns` of the whole table, done in place.

    After a run at ``last_run`` every item stands where its age allows. Until ``as_of`` only items of
    few months pass the next age, so only these months are opened, and only those written in which
    an item does move. Items that were added or edited since (``changed``, column ``sku``) may stand
    anywhere, so their months are opened too.
    """
    months: set[Month] = {*months_due(last_run, as_of)} & {*store_months(spark, folder, "items")}
    if changed is not None:
        months |= {*months_of_keys(spark, folder, "items", changed.select(F.col("sku").alias("key")))}
    if not months:
        return Touched()
    items = load_months(spark, folder, "items", [*months]).select("sku", "active", "sold_at", "listed_at", F.col("markdown_stage").alias("before"), "markdown_stage")
    raised = apply_markdowns(items, as_of).where(~F.col("markdown_stage").eqNullSafe(F.col("before")))
    return upsert_by_month(spark, folder, "items", raised.select("sku", "markdown_stage"))


def _table(spark: SparkSession, folder: str, name: str, path: str | None = None) -> DataFrame:
    return spark.read.schema(StructType([*SCHEMAS[name].fields, StructField(MONTH, StringType())])).parquet(path or f"{folder}/{name}")


def _directory(folder: str, name: str) -> str:
    return f"{folder}/{name}_keys"


def _with_bucket(keys: DataFrame, buckets: int) -> DataFrame:
    return keys.withColumn(_BUCKET, F.pmod(F.xxhash64("key"), F.lit(buckets)).cast("int"))


def _entries(spark: SparkSession, folder: str, name: str, keys: DataFrame) -> DataFrame:
    """The directory's folders that the keys fall into."""
    path = _directory(folder, name)
    buckets = spark.read.schema("buckets int").parquet(f"{path}_buckets").first()["buckets"]
    among = sorted(row[0] for row in _with_bucket(keys.select("key"), buckets).select(_BUCKET).distinct().collect())
    schema = StructType([StructField("key", StringType()), StructField(MONTH, StringType()), StructField(_BUCKET, IntegerType())])
    return spark.read.schema(schema).parquet(path).where(F.col(_BUCKET).isin(among))


def _months_in(entries: DataFrame, keys: DataFrame) -> set[Month]:
    found = entries.join(keys.select("key").distinct(), "key", "left_semi")
    return {row[MONTH] for row in found.select(MONTH).distinct().collect()}


def _add_entries(spark: SparkSession, folder: str, name: str, known: DataFrame, new: DataFrame) -> None:
    """Put ``new`` into the directory's folders that its keys fall into; ``known`` is what these hold."""
    buckets = spark.read.schema("buckets int").parquet(f"{_directory(folder, name)}_buckets").first()["buckets"]
    both = known.unionByName(_with_bucket(new, buckets)).repartition(_BUCKET).distinct()  # dealt by folder once, for both
    _put(spark, _staged(both, folder, name, _BUCKET), _directory(folder, name))


def _staged(rows: DataFrame, folder: str, name: str, by: str) -> str:
    """Write ``rows`` in folders of ``by`` beside the table, on its file system, and return where."""
    path = f"{folder}/_{name}-{uuid.uuid4().hex}"
    rows.write.partitionBy(by).parquet(path)
    return path


def _put(spark: SparkSession, staged: str, path: str) -> list[str]:
    """Move the folders in ``staged`` into the places of those of ``path`` with their names, and return these names."""
    fs, place = _file_system(spark, path)
    folders = [f.getPath() for f in fs.listStatus(place(staged)) if f.isDirectory()]
    for new in folders:
        old = place(path, new.getName())
        fs.delete(old, True)
        if not fs.rename(new, old):
            raise OSError(f"{new} can't be moved to {old}")
    fs.delete(place(staged), True)
    spark.catalog.refreshByPath(path)
    return [new.getName() for new in folders]


def _put_months(spark: SparkSession, staged: str, path: str, months: set[Month]) -> Touched:
    """Put the month folders of ``staged`` in the place of what these months of ``path`` hold."""
    left = {_month_in(name) for name in _put(spark, staged, path)}
    return _emptied(spark, path, months, left)


def replace_months(rows: DataFrame, path: str, months: set[Month]) -> Touched:
    """Put ``rows``, stored elsewhere and with their month in ``MONTH``, in the place of what these months of ``path`` hold."""
    left = {row[0] for row in rows.select(MONTH).distinct().collect()}
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
    return _emptied(rows.sparkSession, path, months, left)


def _emptied(spark: SparkSession, path: str, months: set[Month], left: set[Month]) -> Touched:
    """What a change of ``months`` has touched that left rows in the months ``left``; the others' folders go."""
    emptied = _ordered(months - left)
    for month in emptied:
        _drop_folder(spark, f"{path}/{MONTH}={month or _NO_MONTH}")
    return Touched(_ordered(months | left), emptied)


def _file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """Hadoop's file system of ``path`` and its class of paths."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    return place(path).getFileSystem(spark._jsc.hadoopConfiguration()), place


def _drop_folder(spark: SparkSession, path: str) -> None:
    fs, place = _file_system(spark, path)
    fs.delete(place(path), True)


def month_of(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def _month_in(file: str) -> Month:
    (month,) = (part.partition("=")[2] for part in file.split("/") if part.startswith(f"{MONTH}="))
    return None if month == _NO_MONTH else unquote(month)


def among(column: str, values: Sequence[Month]) -> Column:
    named = F.col(column).isin([v for v in values if v is not None])
    return named | F.col(column).isNull() if None in values else named


def _ordered(months: set[Month]) -> list[Month]:
    return sorted(months, key=lambda m: m or "", reverse=True)
