"""Substring search over a text column by an index of its trigrams.

The index holds each distinct text once, and for every trigram of its lower-cased form one posting. It
lies in folders by a hash of the trigram, so a search opens the folders of its own trigrams alone.
What the postings leave is compared with the needle itself; a needle without three letters in a row
scans the distinct texts.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackwise.functions.columns import in_stock
from rackwise.operators import listings
from rackwise.sources.tables import Tables

BUCKETS = 64
_SIZE = 3
_POSTINGS = "trigram string, text string, bucket int"


def create_text_index(texts: DataFrame, column: str, folder: str) -> None:
    """Write the index of one column to a fresh folder; NULL is no text."""
    distinct = texts.select(F.col(column).alias("text")).where("text is not null").distinct()
    distinct.write.mode("errorifexists").parquet(f"{folder}/texts")
    low = F.lower("text")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(low) - (_SIZE - 1), F.lit(1))), lambda i: F.substring(low, i, F.lit(_SIZE))))
    postings = distinct.select(F.explode(grams).alias("trigram"), "text").withColumn("bucket", _bucket(F.col("trigram")))
    # Sorted, so that within a folder the ranges of row groups tell where a trigram can be.
    postings.repartitionByRange("bucket", "trigram", "text").sortWithinPartitions("bucket", "trigram").write.mode("errorifexists").partitionBy("bucket").parquet(f"{folder}/postings")


def texts_containing(spark: SparkSession, folder: str, needle: str) -> DataFrame:
    """The distinct texts (``text``) that contain ``needle``, ignoring case and without wildcards; none for an empty needle."""
    if not needle:
        return _texts(spark, folder).where(F.lit(False))
    return _verified(spark, folder, [needle], F.lower("text").contains(F.lower(F.lit(needle))))


def texts_like(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """The distinct texts that hold a match of a LIKE pattern (``%`` and ``_`` are wildcards, nothing escapes them), ignoring case."""
    return _verified(spark, folder, re.split("[%_]", pattern), F.ilike(F.col("text"), F.lit(f"%{pattern}%"), F.lit("\u0001")))


def search_consignors(t: Tables, folder: str, text: str, limit: int = 5) -> DataFrame:
    """:func:`listings.search_consignors` by an index of the consignors' names."""
    found = texts_containing(t.consignors.sparkSession, folder, text)
    return listings.active_consignors(t).join(found, F.col("name") == F.col("text"), "left_semi").orderBy("name", "id").limit(limit)


def gallery_by_brand(t: Tables, folder: str, brand: str, category: str | None = None, with_photos: bool = False) -> DataFrame:
    """:func:`listings.gallery` of the brands that match, by an index of the items' brands."""
    found = texts_like(t.items.sparkSession, folder, brand)
    items = t.items.filter(in_stock()).join(found, F.col("brand") == F.col("text"), "left_semi")
    return listings.gallery(Tables(t.consignors, items, t.sales), category=category, with_photos=with_photos)


def _bucket(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(BUCKETS)).cast("int")


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("text string").parquet(f"{folder}/texts")


def _verified(spark: SparkSession, folder: str, pieces: Sequence[str], matches: Column) -> DataFrame:
    """Texts that hold every trigram of the pieces, and match."""
    low = F.transform(F.array(*[F.lit(p) for p in pieces]), F.lower)
    lowered: list[str] = spark.range(1).select(low).first()[0]  # by Spark's own rules of lower case
    grams = sorted({p[k:k + _SIZE] for p in lowered for k in range(len(p) - _SIZE + 1)})
    if not grams:
        return _texts(spark, folder).where(matches)
    buckets = spark.range(1).select(F.array_distinct(F.array(*[_bucket(F.lit(g)) for g in grams]))).first()[0]
    postings = spark.read.schema(_POSTINGS).parquet(f"{folder}/postings").where(F.col("bucket").isin(buckets) & F.col("trigram").isin(grams))
    return postings.groupBy("text").agg(F.count("*").alias("n")).where(F.col("n") == len(grams)).where(matches).select("text")
