"""Stock analyses by category, size and markdown stage.

All groups here are aggregated in two steps by Spark: partial sums in the scanning tasks, then one
row per group and task through the shuffle. A category holding a third of the stock is no hot spot.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackwise.functions.columns import in_stock, rate_percent, stage_name, stock_value
from rackwise.functions.dates import in_period, older_than, over_period, since
from rackwise.sources.tables import Tables

NO_SIZE = "null"


def _sell_through(t: Tables, start: dt.date, end: dt.date, min_total: int, distinct_items: bool) -> DataFrame:
    sold = t.sales.filter(in_period("date", start, end)).groupBy(F.col("sku").alias("_sku")).agg(F.count("*").alias("_n"))
    listed = t.items.filter(F.col("listed_at") >= F.lit(start)).select("sku", "category", "size")
    n_sales = F.coalesce("_n", F.lit(0).cast("bigint"))
    if distinct_items:
        n_sales = F.least(n_sales, F.lit(1).cast("bigint"))
    return (
        listed.join(sold, F.col("sku") == F.col("_sku"), "left").groupBy("category", "size")
        .agg(F.sum(n_sales).alias("sold"), F.sum(F.greatest(n_sales, F.lit(1).cast("bigint"))).alias("total"))
        .filter(F.col("total") >= min_total)
        .withColumn("rate", rate_percent(F.col("sold"), F.col("total")))
    )


@over_period
def sell_through_matrix(
    t: Tables, start: dt.date, end: dt.date, min_total: int = 2, distinct_items: bool = False
) -> DataFrame:
    """Sold share by category and size for items listed from ``start`` on.

    ``total`` counts joined rows, so an item with two sales in the period counts twice in ``sold``
    and ``total``. ``distinct_items=True`` counts each item once instead.
    """
    return _sell_through(t, start, end, min_total, distinct_items).orderBy("category", "size")


@over_period
def sell_through_pivot(
    t: Tables, start: dt.date, end: dt.date, sizes: Sequence[str | None] | None = None, min_total: int = 2
) -> DataFrame:
    """The matrix with one column per size and 0 where a pair is missing; items without a size have column ``null``.

    Spark first runs a job to find the sizes. With ``sizes`` (which may hold None) the columns are
    the caller's choice, other sizes are left out, and the plan stays lazy.
    """
    matrix = _sell_through(t, start, end, min_total, distinct_items=False).withColumn("size", F.coalesce("size", F.lit(NO_SIZE)))
    chosen = None if sizes is None else [NO_SIZE if s is None else s for s in sizes]
    pivoted = matrix.groupBy("category").pivot("size", chosen).agg(F.first("rate"))
    return pivoted.fillna(0.0).orderBy("category")


def stock_by_stage(t: Tables) -> DataFrame:
    """Items in stock and their value at the current price, by markdown stage."""
    return stages_report(t.items.filter(in_stock()).groupBy("markdown_stage").agg(F.count("*").alias("qty"), stock_value().alias("current_value")))


def stages_report(sums: DataFrame) -> DataFrame:
    return sums.select("markdown_stage", stage_name(style="long").alias("stage_name"), "qty", "current_value").orderBy("markdown_stage")


def slow_movers(t: Tables, as_of: dt.date, min_days: int = 60, below_stage: int = 2, n: int = 5) -> DataFrame:
    """Categories with the most items listed long ago and still little reduced."""
    return (
        t.items.filter(in_stock() & older_than("listed_at", as_of, min_days) & (F.col("markdown_stage") < below_stage))
        .groupBy("category").agg(F.count("*").alias("qty"))
        .orderBy(F.col("qty").desc(), "category").limit(n)
    )


def stock_gaps(t: Tables, below: int = 3, n: int = 10) -> DataFrame:
    """Category and size pairs with the least stock; pairs with none at all do not show."""
    return (
        t.items.filter(in_stock()).groupBy("category", "size").agg(F.count("*").alias("current_stock"))
        .filter(F.col("current_stock") < below)
        .orderBy("current_stock", "category", "size").limit(n)
    )


def _ageing(t: Tables, as_of: dt.date, min_days: int, over: int) -> DataFrame:
    old = F.count_if(older_than("listed_at", as_of, min_days)).alias("old_items")
    return with_ageing(t.items.filter(in_stock()).groupBy("category").agg(F.count("*").alias("total_items"), old), over)


def with_ageing(sums: DataFrame, over: int) -> DataFrame:
    return sums.filter(F.col("total_items") > over).withColumn("old_pct", rate_percent(F.col("old_items"), F.col("total_items")))


def oldest_first() -> list[Column]:
    return [F.col("old_pct").desc(), F.col("total_items").desc(), F.col("category").asc()]


def category_ageing(t: Tables, as_of: dt.date, min_days: int = 60, over: int = 5) -> DataFrame:
    """Stock per category and how much of it is old, for categories with more than ``over`` items."""
    return _ageing(t, as_of, min_days, over).orderBy(*oldest_first())


def problem_categories(t: Tables, as_of: dt.date, over_pct: float = 50, min_days: int = 60, over: int = 5) -> DataFrame:
    """Categories most of whose stock is old."""
    return _ageing(t, as_of, min_days, over).filter(F.col("old_pct") > over_pct).orderBy(*oldest_first())


def low_demand(
    t: Tables, as_of: dt.date, days: int = 90, min_items: int = 3, mean_days_over: float = 45, n: int = 10
) -> DataFrame:
    """Category and size pairs listed lately that did not sell, or sold slowly.

    Goes by the items' own sold date. ``current_stock`` counts sold and inactive items too.
    """
    is_sold = F.col("sold_at").isNotNull()
    day_count = F.datediff("sold_at", "listed_at")
    return (
        t.items.filter(since("listed_at", as_of, days)).groupBy("category", "size")
        .agg(
            F.count("*").alias("current_stock"),
            F.count_if(is_sold).alias("sold_ever"),
            (F.sum(day_count).cast("double") / F.nullif(F.count(day_count), F.lit(0).cast("bigint"))).alias("avg_days_when_sold"),
        )
        .filter((F.col("current_stock") >= min_items) & ((F.col("sold_ever") == 0) | (F.col("avg_days_when_sold") > mean_days_over)))
        .orderBy(F.col("current_stock").desc(), "category", "size").limit(n)
        .withColumn("avg_days_when_sold", F.bround(F.coalesce("avg_days_when_sold", F.lit(0.0)), 1))
    )
