"""Consignor performance over the last 30 days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackwise.functions.columns import net_units, rate_percent, total
from rackwise.functions.dates import since
from rackwise.sources.tables import Tables


def _performance(t: Tables, as_of: dt.date, days: int, distinct_items: bool) -> DataFrame:
    """Unrounded gaps kept: no rate without added items, no revenue without sales.

    Consignors, items and sales are chained by left joins, so an item counts once per sale of it,
    and once if it has none. Folding the sales to one row per SKU first gives the same counts:
    the number of joined rows of an item is the larger of one and its number of sales.
    """
    recent_sale = since("date", as_of, days)
    per_sku = t.sales.groupBy(F.col("sku").alias("_sku")).agg(
        F.count("*").alias("_n"),
        F.count_if(recent_sale).alias("_n_recent"),
        F.sum(F.when(recent_sale, net_units())).alias("_net_recent"),
    )
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    joined_rows = one if distinct_items else F.greatest(F.coalesce("_n", zero), one)
    n_recent = F.coalesce("_n_recent", zero)
    if distinct_items:
        n_recent = F.least(n_recent, one)
    owned = t.items.filter(F.col("consignor_id").isNotNull()).select("sku", "consignor_id", "listed_at")
    per_consignor = (
        owned.join(per_sku, F.col("sku") == F.col("_sku"), "left").groupBy("consignor_id")
        .agg(
            F.sum(F.when(since("listed_at", as_of, days), joined_rows).otherwise(zero)).alias("items_added_30d"),
            F.sum(n_recent).alias("items_sold_30d"),
            total("_net_recent").alias("revenue_30d"),
        )
        .filter((F.col("items_added_30d") > 0) | (F.col("items_sold_30d") > 0))
    )
    active = t.consignors.filter(F.col("active") == 1).select("id", "name")
    return active.join(per_consignor, F.col("id") == F.col("consignor_id")).select(
        "id", "name", "items_added_30d", "items_sold_30d",
        rate_percent(F.col("items_sold_30d"), F.col("items_added_30d")).alias("sell_through_rate"), "revenue_30d",
    )


def _best_first() -> list[Column]:
    return [F.col("sell_through_rate").desc_nulls_last(), F.col("revenue_30d").desc_nulls_last(), F.col("id").asc()]


def _shown(performance: DataFrame) -> DataFrame:
    return performance.drop("id").fillna(0.0, ["sell_through_rate", "revenue_30d"])


def consignor_performance(t: Tables, as_of: dt.date, days: int = 30, distinct_items: bool = False) -> DataFrame:
    """Items added, sold, rate and revenue per active consignor; idle consignors are hidden.

    Goes by the consignor the item has now. ``distinct_items=True`` counts each item once.
    """
    return _shown(_performance(t, as_of, days, distinct_items).orderBy(*_best_first()))


def top_performers(t: Tables, as_of: dt.date, min_rate: float = 50, n: int = 3) -> DataFrame:
    rated = _performance(t, as_of, 30, False).filter(F.col("sell_through_rate") >= min_rate)
    return _shown(rated.orderBy(*_best_first()).limit(n))


def low_performers(t: Tables, as_of: dt.date, min_added: int = 5, below_rate: float = 20, n: int = 3) -> DataFrame:
    rated = _performance(t, as_of, 30, False).filter(
        (F.col("items_added_30d") >= min_added) & (F.coalesce("sell_through_rate", F.lit(0.0)) < below_rate)
    )
    return _shown(rated.orderBy(*_best_first()).limit(n))
