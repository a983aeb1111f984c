"""Key figures for a period, and the daily action summary."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackwise.functions import fixed_values as fixed
from rackwise.functions.columns import in_stock, total
from rackwise.functions.dates import in_period, older_than, over_period
from rackwise.operators.markdown import steps_due
from rackwise.operators.sales_reports import mean_days_to_sell, sales_by_sku
from rackwise.sources.tables import Tables


@over_period
def kpis(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """One row: stock, sales, net revenue, sales per listed item in percent, mean days to sell.

    Items and sales are read once each: the sales, folded per SKU, meet the items in one outer join.
    Sales and listings of a period are different sets, so the rate may exceed 100. A sale of no known
    item counts as a sale; it has no days to sell.
    """
    sold = sales_by_sku(t.sales.filter(in_period("date", start, end)))
    both = t.items.join(sold, F.col("_sku") == F.col("sku"), "full_outer").agg(
        F.count_if(in_stock()).alias("total_stock"),
        F.count_if(in_period("listed_at", start, end)).alias("listed"),
        F.sum("n_sales").alias("n_sold"),
        total("net_sum").alias("revenue"),
        mean_days_to_sell().alias("mean_days"),
    )
    return kpi_row(both)


def kpi_row(sums: DataFrame) -> DataFrame:
    n_sold = F.coalesce("n_sold", F.lit(0).cast("bigint"))
    return sums.select(
        "total_stock",
        n_sold.alias("period_sales_count"),
        F.coalesce("revenue", F.lit(0.0)).alias("period_revenue"),
        F.when(F.col("listed") > 0, n_sold / F.col("listed") * 100).otherwise(F.lit(0.0)).alias("sell_through_rate"),
        F.coalesce("mean_days", F.lit(0.0)).alias("avg_days_to_sell"),
    )


@over_period
def kpi_cards(t: Tables, start: dt.date, end: dt.date) -> DataFrame:
    """The key figures as heading and text, one row each."""
    texts = [
        F.format_number("total_stock", 0),
        F.format_number("period_sales_count", 0),
        F.concat(F.lit(fixed.PRICE_TEXT), F.format_number("period_revenue", 2)),
        F.format_string("%.1f%%", F.bround("sell_through_rate", 1)),
        F.format_string("%.1f", F.bround("avg_days_to_sell", 1)),
    ]
    cards = [F.struct(F.lit(h).alias("metric"), v.alias("value")) for h, v in zip(fixed.KPI_HEADINGS, texts, strict=True)]
    return kpis(t, start, end).select(F.inline(F.array(*cards)))


def markdown_pending(t: Tables, as_of: dt.date) -> DataFrame:
    """Number of items in stock whose next markdown step is due."""
    return t.items.filter(in_stock()).agg(F.count_if(steps_due(as_of)).alias("markdown_pending"))


def old_items(t: Tables, as_of: dt.date, min_days: int = 90) -> DataFrame:
    return t.items.filter(in_stock() & older_than("listed_at", as_of, min_days)).agg(F.count("*").alias("old_items"))


def overstocked_categories(t: Tables, over: int = 20) -> DataFrame:
    """Number of categories with more than ``over`` items in stock; items without category do not count."""
    return (
        t.items.filter(in_stock() & F.col("category").isNotNull()).groupBy("category").agg(F.count("*").alias("qty"))
        .filter(F.col("qty") > over).agg(F.count("*").alias("overstocked_categories"))
    )


def action_summary(
    t: Tables, as_of: dt.date, min_old_items: int = 10, min_days: int = 90, overstock: int = 20
) -> DataFrame:
    """Suggested actions as text, or one row saying there are none. Items are read once."""
    by_category = t.items.filter(in_stock()).groupBy("category").agg(
        F.count("*").alias("qty"),
        F.count_if(steps_due(as_of)).alias("pending"),
        F.count_if(older_than("listed_at", as_of, min_days)).alias("old"),
    )
    totals = by_category.agg(
        F.coalesce(F.sum("pending"), F.lit(0).cast("bigint")).alias("pending"),
        F.coalesce(F.sum("old"), F.lit(0).cast("bigint")).alias("old"),
        F.count_if((F.col("qty") > overstock) & F.col("category").isNotNull()).alias("overstocked"),
    )
    return action_report(totals, min_old_items)


def action_report(totals: DataFrame, min_old_items: int) -> DataFrame:
    """The actions that one row of ``pending``, ``old``, ``overstocked`` calls for."""
    pending, old, overstocked = F.col("pending") > 0, F.col("old") > min_old_items, F.col("overstocked") > 0
    rows = [
        (pending, F.format_string(fixed.ACTION_MARKDOWN, "pending")),
        (old, F.format_string(fixed.ACTION_OLD_ITEMS, "old")),
        (overstocked, F.format_string(fixed.ACTION_OVERSTOCK, "overstocked")),
        (~(pending | old | overstocked), F.lit(fixed.ACTION_NONE)),
    ]
    candidates = [
        F.struct(F.lit(i).alias("action_no"), text.alias("action"), due.alias("_due")) for i, (due, text) in enumerate(rows, 1)
    ]
    return totals.select(F.inline(F.array(*candidates))).filter("_due").select("action_no", "action").orderBy("action_no")
