"""Reports over sales joined to items or consignors.

One item can have any number of sales, and one consignor can own a large share of them. The
reports first fold the sales to one row per SKU (or per consignor) and join after that: the fold
happens in the scanning tasks, so the shuffle carries one row per key and task however often a
key repeats, and the join has unique keys on both sides. Counts, sums and mean days come out the
same, since each is a sum over the sales of a SKU.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackwise.functions import fixed_values as fixed
from rackwise.functions.columns import MONEY_UNIT, net_units, stage_name, total
from rackwise.functions.dates import in_period, over_period, since
from rackwise.sources.tables import Tables


def sales_by_sku(sales: DataFrame) -> DataFrame:
    """Per SKU: number of sales, net sum in money units, and the sum of sale dates as day numbers."""
    return sales.groupBy(F.col("sku").alias("_sku")).agg(
        F.count("*").alias("n_sales"),
        F.sum(net_units()).alias("net_sum"),
        F.sum(F.unix_date("date")).alias("day_sum"),
    )


def sold_items(sales: DataFrame, items: DataFrame, *columns: str) -> DataFrame:
    """Items with at least one of ``sales``, and the sums over those sales."""
    item = items.select("sku", "listed_at", *columns)
    return sales_by_sku(sales).join(item, F.col("_sku") == F.col("sku"))


def mean_days_to_sell() -> Column:
    """Mean of sale date less listing date over the sales behind :func:`sold_items` rows."""
    days = F.sum(F.col("day_sum") - F.col("n_sales") * F.unix_date("listed_at"))
    sales_with_days = F.sum(F.when(F.col("listed_at").isNotNull(), F.col("n_sales")))
    return days.cast("double") / sales_with_days


@over_period
def category_revenue(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """Number and net revenue of the period's sales by category, in no order."""
    sales = t.sales.filter(in_period("date", start, end))
    return sold_items(sales, t.items, "category").groupBy("category").agg(
        F.sum("n_sales").alias("qty"), total("net_sum").alias("revenue")
    )


@over_period
def revenue_by_category(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """Number and net revenue of the period's sales by category, highest revenue first."""
    return category_revenue(t, start, end).orderBy(F.col("revenue").desc(), "category")


@over_period
def performance_by_stage(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """Sales in the period and mean days to sell, by the item's markdown stage."""
    sales = t.sales.filter(in_period("date", start, end))
    return stage_report(sold_items(sales, t.items, "markdown_stage").groupBy("markdown_stage")
                        .agg(F.sum("n_sales").alias("sold_qty"), mean_days_to_sell().alias("avg_days")))


def stage_report(sums: DataFrame) -> DataFrame:
    return sums.select("markdown_stage", stage_name(style="short").alias("stage_name"), "sold_qty", "avg_days").orderBy("markdown_stage")


def high_demand(
    t: Tables, as_of: dt.date, days: int = 30, min_sold: int = 3, max_mean_days: float = 14, n: int = 10
) -> DataFrame:
    """Category and size pairs that sold often and fast in the last ``days`` days."""
    sales = t.sales.filter(since("date", as_of, days))
    sums = sold_items(sales, t.items, "category", "size").groupBy("category", "size").agg(
        F.sum("n_sales").alias("total_sold"), mean_days_to_sell().alias("avg_days_to_sell"))
    return demand_report(sums, min_sold, max_mean_days, n)


def demand_report(sums: DataFrame, min_sold: int, max_mean_days: float, n: int) -> DataFrame:
    return (
        sums.filter((F.col("total_sold") >= min_sold) & (F.col("avg_days_to_sell") <= max_mean_days))
        .orderBy(F.col("total_sold").desc(), "avg_days_to_sell", "category", "size").limit(n)
        .withColumn("avg_days_to_sell", F.bround("avg_days_to_sell", 1))
    )


def _by_consignor(sales: DataFrame) -> DataFrame:
    return (
        sales.filter(F.col("consignor_id").isNotNull()).groupBy("consignor_id")
        .agg(F.count("*").alias("n_sales"), F.sum(net_units()).alias("net_sum"))
    )


@over_period
def top_consignors(t: Tables, start: dt.date, end: dt.date, n: int = 10) -> DataFrame:
    """Consignors with the highest net revenue in the period, by the consignor noted on the sale."""
    return top_report(_by_consignor(t.sales.filter(in_period("date", start, end))), t.consignors, n)


def top_report(sold: DataFrame, consignors: DataFrame, n: int) -> DataFrame:
    names = consignors.select("id", "name")
    return (
        sold.join(names, F.col("consignor_id") == F.col("id"))
        .orderBy(F.col("net_sum").desc(), "id").limit(n)
        .select(
            "name", F.col("n_sales").alias("items_sold"), (F.col("net_sum") / MONEY_UNIT).alias("total_revenue"),
            (F.col("net_sum") / MONEY_UNIT / F.col("n_sales")).alias("avg_price"),
        )
    )


def payout_split(df: DataFrame) -> DataFrame:
    """Add the consignor's and the shop's part of ``total_net``.

    Values that are no number count as zero. Without a ``percent`` column the share is one half.
    """
    net = _number_or_zero(df, "total_net", 0.0, "decimal(24,4)")
    percent = _number_or_zero(df, "percent", fixed.DEFAULT_PERCENT, "decimal(9,6)")
    consignor_value = F.round(net * percent, 2)
    return df.withColumns({
        "consignor_value": consignor_value.cast("double"),
        "shop_value": F.round(net - consignor_value, 2).cast("double"),
    })


def _number_or_zero(df: DataFrame, column: str, missing: float, decimal: str) -> Column:
    if column not in df.columns:
        return F.lit(missing).cast(decimal)
    return F.coalesce(F.col(column).try_cast(decimal), F.lit(0).cast(decimal))


@over_period
def payouts(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """Net sales per consignor in the period and how they are split, highest total first.

    Sales without a consignor are left out; a deleted consignor keeps a row with an empty name.
    """
    return payout_totals(_by_consignor(any_price(t.sales.filter(in_period("date", start, end)))), t.consignors)


def any_price(sales: DataFrame) -> DataFrame:
    """Unlike in the other reports, in payouts a sale without a price still gives its discount."""
    return sales.withColumn("sale_price", F.coalesce("sale_price", F.lit(0.0)))


def payout_totals(sold: DataFrame, consignors: DataFrame) -> DataFrame:
    owners = consignors.select(F.col("id").alias("_id"), "name", "pix_key", "percent")
    totals = sold.join(owners, F.col("consignor_id") == F.col("_id"), "left").select(
        "consignor_id", "name", "pix_key", F.coalesce("percent", F.lit(fixed.DEFAULT_PERCENT)).alias("percent"),
        (F.coalesce("net_sum", F.lit(0).cast("bigint")) / MONEY_UNIT).alias("total_net"), F.col("n_sales").alias("qtd"),
    )
    return payout_split(totals).orderBy(F.col("total_net").desc(), "consignor_id")


@over_period
def payout_report(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """Payouts under their report headings, ready for CSV."""
    return payouts(t, start, end).select(*[F.col(c).alias(heading) for c, heading in fixed.PAYOUT_HEADINGS.items()])
