"""ABC classes: categories ranked by revenue and cut by their running share."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rackwise.functions.columns import MONEY_UNIT
from rackwise.functions.dates import in_period, over_period
from rackwise.operators.sales_reports import category_revenue, sales_by_sku
from rackwise.sources.tables import Tables
from rackwise.sources.workspace import stored


def abc_classes(revenue: DataFrame, a_up_to: float = 80, b_up_to: float = 95) -> DataFrame:
    """Add share, running share and class to rows of ``category``, ``qty``, ``revenue``.

    The running sum adds the rounded shares, own share included, as decimals: a sum of doubles
    could sit a hair off the limits. Its window has no partitions, which is safe here because the
    input holds one row per category of the shop's fixed category list.
    """
    everything = Window.partitionBy()
    ranked = Window.orderBy(F.col("revenue").desc(), "category").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.nullif(F.sum("revenue").over(everything), F.lit(0.0))
    running = F.sum(F.col("share_pct").cast("decimal(18,1)")).over(ranked)
    return (
        revenue.withColumn("share_pct", F.bround(F.col("revenue") / total * 100, 1))
        .withColumn("cumulative_pct", running.cast("double"))
        .withColumn(
            "abc_class",
            F.when(F.col("cumulative_pct") <= a_up_to, "A").when(F.col("cumulative_pct") <= b_up_to, "B").otherwise("C"),
        )
    )


def abc_classes_of_many(revenue: DataFrame, key: str, a_up_to: float = 80, b_up_to: float = 95) -> DataFrame:
    """:func:`abc_classes` for any number of rows of ``key`` and ``revenue``: no window sees more than one partition.

    The rows are placed by revenue and key in ranges, each sorted by one task, and stored, so that both
    uses see the same places. A range's running sum starts at the sum of the ranges before it. Shares
    are not rounded: each of very many rows would round to 0. Running sums are exact decimals of the revenue.
    """
    amount = F.coalesce(F.col("revenue"), F.lit(0.0)).cast("decimal(28,4)")
    order = [F.col("revenue").desc_nulls_last(), F.col(key).asc_nulls_last()]
    placed = revenue.repartitionByRange(*order).withColumns({"_range": F.spark_partition_id(), "_amount": amount})
    placed = stored(placed, "abc-ranges")
    sums = placed.groupBy("_range").agg(F.sum("_amount").alias("_sum"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    everything = F.sum("_sum").over(Window.partitionBy())
    # One row per range.
    offsets = stored(sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), everything.alias("_all")), "abc-offsets")
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = placed.withColumn("_running", F.sum("_amount").over(within)).join(offsets, "_range")
    total = F.nullif(F.col("_all"), F.lit(0)).cast("double")
    shares = {
        "share_pct": F.col("_amount").cast("double") / total * 100,
        "cumulative_pct": (F.col("_running") + F.col("_before")).cast("double") / total * 100,
    }
    up_to = [(F.lit(str(limit)).cast("decimal(5,2)") * F.col("_all"), name) for limit, name in ((a_up_to, "A"), (b_up_to, "B"))]
    reached = (F.col("_running") + F.col("_before")) * 100
    # Compared as decimals: a row that ends exactly on a limit belongs below it.
    abc_class = F.when(reached <= up_to[0][0], up_to[0][1]).when(reached <= up_to[1][0], up_to[1][1]).otherwise("C")
    return running.withColumns(shares | {"abc_class": F.when(F.col("_all") != 0, abc_class).otherwise("C")}).select(*revenue.columns, *shares, "abc_class")


@over_period
def abc_by_item(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """ABC classes of all items sold in the period, by SKU, known to the items or not."""
    sold = sales_by_sku(t.sales.filter(in_period("date", start, end)))
    revenue = sold.select(F.col("_sku").alias("sku"), F.col("n_sales").alias("qty"), (F.col("net_sum") / MONEY_UNIT).alias("revenue"))
    return abc_classes_of_many(revenue, "sku")


@over_period
def abc_analysis(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    return abc_classes(category_revenue(t, start, end)).orderBy(F.col("revenue").desc(), "category")


@over_period
def abc_summary(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """Categories, revenue and share by class."""
    return (
        abc_classes(category_revenue(t, start, end)).groupBy("abc_class")
        .agg(
            F.count("category").alias("categories"),
            F.bround(F.sum(F.col("revenue").cast("decimal(28,4)")), 2).cast("double").alias("revenue"),
            F.sum(F.col("share_pct").cast("decimal(18,1)")).cast("double").alias("share_pct"),
        )
        .orderBy("abc_class")
    )
