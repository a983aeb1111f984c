"""Stored daily sums of the sales, which the sales reports fold instead of reading sales.

Two tables in month folders: sums by day and item group (category, size, markdown stage), and by day and
consignor. All are counts, whole money units and day numbers, so sums of sums are exact and any days
can be put together. After a change only the months it touched are summed anew.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rackwise.functions.columns import in_stock, net_units, total
from rackwise.functions.dates import day_of, in_period, over_period, since
from rackwise.operators import abc
from rackwise.operators.kpis import kpi_row
from rackwise.operators.sales_reports import any_price, demand_report, payout_totals, stage_report, top_report
from rackwise.sources.store import Month, load_months, month_of, replace_months
from rackwise.sources.tables import MONTH, Tables, load_table
from rackwise.sources.workspace import stored

_GROUP = ["category", "size", "markdown_stage"]
_GROUPS_SCHEMA = (
    "date date, category string, size string, markdown_stage int, of_item boolean, n_sales long, net_sum long, n_dated long, day_sum long, "
    f"{MONTH} string"
)
_CONSIGNORS_SCHEMA = f"date date, consignor_id string, n_sales long, net_sum long, owed_sum long, {MONTH} string"


@dataclass(frozen=True)
class Rollups:
    """``groups``: sums by day and item group, ``of_item`` false for sales of no known item; ``owners``: by day and consignor."""

    groups: DataFrame
    owners: DataFrame


def group_sums(sales: DataFrame, items: DataFrame) -> DataFrame:
    """Per day and item group: sales, net, and of the sales whose item has a listing date the number and the days to sell.

    The sales are folded per day and SKU first, so a SKU with very many sales is one row per day and task.
    """
    daily = sales.groupBy("date", F.col("sku").alias("_sku")).agg(F.count("*").alias("n"), F.sum(net_units()).alias("net"))
    item = items.select("sku", "listed_at", *_GROUP)
    days = F.col("n") * F.datediff("date", "listed_at")
    return daily.join(item, F.col("_sku") == F.col("sku"), "left").groupBy("date", *_GROUP, F.col("sku").isNotNull().alias("of_item")).agg(
        F.sum("n").alias("n_sales"), F.sum("net").alias("net_sum"),
        F.sum(F.when(days.isNotNull(), F.col("n"))).alias("n_dated"), F.sum(days).alias("day_sum"),
    ).withColumn(MONTH, month_of(F.col("date")))


def consignor_sums(sales: DataFrame) -> DataFrame:
    """Per day and consignor: sales, net, and what payouts count (a sale without a price as its discount)."""
    both = any_price(sales.withColumn("_net", net_units())).where("consignor_id is not null")
    return both.groupBy("date", "consignor_id").agg(
        F.count("*").alias("n_sales"), F.sum("_net").alias("net_sum"), F.sum(net_units()).alias("owed_sum"),
    ).withColumn(MONTH, month_of(F.col("date")))


def create_rollups(t: Tables, folder: str) -> None:
    """Write the sums of all sales to a fresh folder."""
    for name, sums in (("sales_by_group", group_sums(t.sales, t.items)), ("sales_by_consignor", consignor_sums(t.sales))):
        sums.repartitionByRange("date").write.mode("errorifexists").partitionBy(MONTH).parquet(f"{folder}/{name}")


def load_rollups(spark: SparkSession, folder: str) -> Rollups:
    groups = spark.read.schema(_GROUPS_SCHEMA).parquet(f"{folder}/sales_by_group")
    return Rollups(groups, spark.read.schema(_CONSIGNORS_SCHEMA).parquet(f"{folder}/sales_by_consignor"))


def refresh_rollups(spark: SparkSession, store: str, folder: str, months: Sequence[Month], changed_items: DataFrame | None = None) -> list[Month]:
    """Sum these months of the store's sales anew, as after a change that touched them; the others stay.

    Sums by item group hold what the items were. ``changed_items`` (``sku``) names items whose group or listing
    date changed; the months that hold sales of theirs are summed anew as well, found from the sales' SKUs alone.
    Returns the months summed.
    """
    due = {*months}
    if changed_items is not None:
        skus = load_table(spark, store, "sales").select("date", "sku").join(changed_items.select("sku").distinct(), "sku", "left_semi")
        due |= {row[0] for row in skus.select(month_of(F.col("date"))).distinct().collect()}
    if due:
        sales = load_months(spark, store, "sales", [*due])
        replace_months(stored(group_sums(sales, load_table(spark, store, "items")), "group-sums"), f"{folder}/sales_by_group", due)
        replace_months(stored(consignor_sums(sales), "consignor-sums"), f"{folder}/sales_by_consignor", due)
    return sorted(due, key=lambda m: m or "")


def _days(sums: DataFrame, start: dt.date, end: dt.date | None = None) -> DataFrame:
    """The sums of some days; other months' files are not opened."""
    in_month = F.col(MONTH) >= f"{start:%Y-%m}"
    if end is None:
        return sums.filter(in_month & (F.col("date") >= F.lit(start)))
    return sums.filter(in_month & (F.col(MONTH) <= f"{end:%Y-%m}") & in_period("date", start, end))


def _mean_days() -> Column:
    return F.sum("day_sum").cast("double") / F.nullif(F.sum("n_dated"), F.lit(0).cast("bigint"))


@over_period
def rolled_kpis(r: Rollups, start: dt.date, end: dt.date, items: DataFrame) -> DataFrame:
    """:func:`kpis.kpis` from sums and items."""
    stock = items.agg(F.struct(F.count_if(in_stock()).alias("total_stock"), F.count_if(in_period("listed_at", start, end)).alias("listed"))).scalar()
    sums = _days(r.groups, start, end).agg(F.sum("n_sales").alias("n_sold"), total("net_sum").alias("revenue"), _mean_days().alias("mean_days"))
    return kpi_row(sums.select("*", stock.getField("total_stock").alias("total_stock"), stock.getField("listed").alias("listed")))


@over_period
def rolled_category_revenue(r: Rollups, start: dt.date, end: dt.date) -> DataFrame:
    sums = _days(r.groups, start, end).filter("of_item")
    return sums.groupBy("category").agg(F.sum("n_sales").alias("qty"), total("net_sum").alias("revenue"))


@over_period
def rolled_revenue_by_category(r: Rollups, start: dt.date, end: dt.date) -> DataFrame:
    return rolled_category_revenue(r, start, end).orderBy(F.col("revenue").desc(), "category")


@over_period
def rolled_abc_analysis(r: Rollups, start: dt.date, end: dt.date) -> DataFrame:
    return abc.abc_classes(rolled_category_revenue(r, start, end)).orderBy(F.col("revenue").desc(), "category")


@over_period
def rolled_performance_by_stage(r: Rollups, start: dt.date, end: dt.date) -> DataFrame:
    sums = _days(r.groups, start, end).filter("of_item").groupBy("markdown_stage")
    return stage_report(sums.agg(F.sum("n_sales").alias("sold_qty"), _mean_days().alias("avg_days")))


def rolled_high_demand(r: Rollups, as_of: dt.date, days: int = 30, min_sold: int = 3, max_mean_days: float = 14, n: int = 10) -> DataFrame:
    sums = _days(r.groups, day_of(as_of) - dt.timedelta(days=days)).filter(since("date", as_of, days) & F.col("of_item")).groupBy("category", "size")
    return demand_report(sums.agg(F.sum("n_sales").alias("total_sold"), _mean_days().alias("avg_days_to_sell")), min_sold, max_mean_days, n)


@over_period
def rolled_top_consignors(r: Rollups, start: dt.date, end: dt.date, consignors: DataFrame, n: int = 10) -> DataFrame:
    return top_report(_by_consignor(r, start, end, "net_sum"), consignors, n)


@over_period
def rolled_payouts(r: Rollups, start: dt.date, end: dt.date, consignors: DataFrame) -> DataFrame:
    return payout_totals(_by_consignor(r, start, end, "owed_sum"), consignors)


def _by_consignor(r: Rollups, start: dt.date, end: dt.date, units: str) -> DataFrame:
    return _days(r.owners, start, end).groupBy("consignor_id").agg(F.sum("n_sales").alias("n_sales"), F.sum(units).alias("net_sum"))
