"""Lists of consignors, items and sales: projections, filters, orders and top-n.

Every order ends in a key column, so a top-n is the same on every run.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackwise.functions import fixed_values as fixed
from rackwise.functions.columns import (
    exact_markdown_price, in_stock, item_title, has_photo, markdown_price, percent_off, price_text, stage_name, strip,
)
from rackwise.functions.dates import age_in_days, at_most_old, in_period, older_than, over_period
from rackwise.sources.tables import Tables

LABEL_COLUMNS = ["sku", "category", "brand", "size", "condition", "list_price", "markdown_stage"]


def newest_first() -> list[Column]:
    return [F.col("listed_at").desc(), F.col("sku").desc()]


def consignor_list(t: Tables) -> DataFrame:
    return t.consignors.select("id", "name", "whatsapp", "email", "pix_key", "percent", "active").orderBy("id")


def consignor_cards(t: Tables) -> DataFrame:
    """Display texts: a dash for a missing phone, the share in whole percent, the status."""
    whole_percent = F.bround(F.col("percent") * 100, 0).cast("int").cast("string")
    return t.consignors.select(
        "id", "name",
        F.coalesce(F.nullif("whatsapp", F.lit("")), F.lit(fixed.NO_VALUE)).alias("whatsapp_text"),
        F.concat(whole_percent, F.lit("%")).alias("percent_text"),
        F.when(F.col("active") != 0, F.lit(fixed.STATUS_ACTIVE)).otherwise(F.lit(fixed.STATUS_INACTIVE)).alias("status"),
    ).orderBy("id")


def active_consignors(t: Tables) -> DataFrame:
    return t.consignors.filter(F.col("active") == 1).select("id", "name").orderBy("name", "id")


def search_consignors(t: Tables, text: str, limit: int = 5) -> DataFrame:
    """Active consignors whose name contains ``text``, ignoring case and without wildcards."""
    found = F.lower("name").contains(F.lower(F.lit(text))) if text else F.lit(False)
    return active_consignors(t).filter(found).orderBy("name", "id").limit(limit)


def with_consignor_name(items: DataFrame, consignors: DataFrame) -> DataFrame:
    """Add ``consignor_name``: the active consignor's name, else an empty text.

    Items without a consignor may be a large share of all. They match nobody, so their join key is
    replaced by a text no id can equal, one per item; that keeps them from meeting in one task.
    """
    names = consignors.filter(F.col("active") == 1).select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    key = F.coalesce(F.col("consignor_id"), F.concat(F.lit("\u0001"), F.col("sku")))
    return items.join(names, key == F.col("_id"), "left").select(
        *[items[c] for c in items.columns], F.coalesce("_name", F.lit("")).alias("consignor_name")
    )


def stock_list(t: Tables) -> DataFrame:
    """All items, sold or not, with the current price, newest first."""
    return t.items.select(
        "sku", "consignor_id", "acquisition_type", "category", "brand", "size", "condition", "list_price",
        "markdown_stage", markdown_price().alias("preco_atual"), "channel_listed", "listed_at", "photos_url", "active",
    ).orderBy(*newest_first())


def sales_history(t: Tables) -> DataFrame:
    """All sales with their item's attributes; ``liquido`` is NULL where the discount is."""
    item = t.items.select(F.col("sku").alias("_sku"), "category", "brand", "size")
    s = t.sales
    return s.join(item, s["sku"] == item["_sku"], "left").select(
        s["id"], s["date"], s["sku"], "category", "brand", "size", s["sale_price"], s["discount_value"],
        (s["sale_price"] - s["discount_value"]).alias("liquido"), s["channel"], s["payment_method"], s["consignor_id"],
    ).orderBy(F.col("date").desc(), F.col("id").desc())


def recent_stock(t: Tables, n: int = 100, variant: str = "photo") -> DataFrame:
    """The newest items in stock, with the picker's text and the SKU read back from it."""
    columns = {"photo": ["sku", "category", "brand", "size", "consignor_id"], "label": LABEL_COLUMNS}[variant]
    blank_if_missing = [F.coalesce(F.col(c), F.lit("")) for c in ("category", "brand", "size")]
    text = strip(F.concat(F.col("sku"), F.lit(" - "), F.concat_ws(" ", *blank_if_missing)))
    return (
        t.items.filter(in_stock()).orderBy(*newest_first()).limit(n)
        .select(*columns, text.alias("picker_text"), F.split(text, " - ")[0].alias("picked_sku"))
    )


def item_by_sku(t: Tables, skus: DataFrame) -> DataFrame:
    return t.items.join(skus.select("sku").distinct(), "sku", "left_semi").select(*t.items.columns)


def gallery(t: Tables, category: str | None = None, brand: str | None = None, with_photos: bool = False) -> DataFrame:
    """Items in stock, newest first, with optional filters, and the texts of their cards.

    ``brand`` is a LIKE pattern matched anywhere in the brand, ignoring case.
    """
    items = t.items.filter(in_stock())
    if category is not None:
        items = items.filter(F.col("category") == category)
    if brand:
        items = items.filter(F.ilike(F.col("brand"), F.lit(f"%{brand}%"), F.lit("\u0001")))
    if with_photos:
        items = items.filter(has_photo())
    marked_down = percent_off().isNotNull()
    return items.orderBy(*newest_first()).select(
        "sku", "category", "brand", "size", "condition", "list_price", "markdown_stage", "photos_url",
        item_title().alias("title"),
        markdown_price(rounded_to_cents=False).alias("current_price"),
        price_text(exact_markdown_price()).alias("price_text"),
        F.when(marked_down, price_text(F.col("list_price").cast("decimal(18,4)"))).alias("struck_price_text"),
        F.concat(percent_off().cast("string"), F.lit(fixed.PERCENT_OFF_TEXT)).alias("percent_off_text"),
    )


@over_period
def fast_movers(t: Tables, start: dt.date, end: dt.date, max_days: int = 7, n: int = 10) -> DataFrame:
    """Sales in the period within ``max_days`` of listing, fastest first (sold before listing included)."""
    sold = t.sales.filter(in_period("date", start, end)).select(
        F.col("sku").alias("_sku"), "date", (F.col("sale_price") - F.coalesce("discount_value", F.lit(0.0))).alias("net_price")
    )
    item = t.items.select("sku", "category", "brand", "size", "listed_at")
    return (
        sold.join(item, F.col("_sku") == F.col("sku"))
        .withColumn("days_to_sell", F.datediff("date", "listed_at"))
        .filter(F.col("days_to_sell") <= max_days)
        .orderBy("days_to_sell", "sku", "net_price").limit(n)
        .select("sku", "category", "brand", "size", "days_to_sell", "net_price")
    )


def very_slow_items(t: Tables, as_of: dt.date, min_days: int = 90, n: int = 20) -> DataFrame:
    """The oldest items in stock listed more than ``min_days`` ago."""
    return (
        t.items.filter(in_stock() & older_than("listed_at", as_of, min_days))
        .orderBy("listed_at", "sku").limit(n)
        .select(
            "sku", "category", "brand", "size",
            F.bround(age_in_days("listed_at", as_of), 0).cast("int").alias("days_listed"),
            "list_price", stage_name(style="percent").alias("discount"),
        )
    )


def label_batch(
    t: Tables, as_of: dt.date, category: str | None = None, max_age: int | None = None, n: int = 10
) -> DataFrame:
    """Newest items in stock to print labels for, 1 to 50 of them."""
    if not 1 <= n <= 50:
        raise ValueError("a label batch holds 1 to 50 items")
    items = t.items.filter(in_stock())
    if category is not None:
        items = items.filter(F.col("category") == category)
    if max_age is not None:
        items = items.filter(at_most_old("listed_at", as_of, max_age))
    return items.orderBy(*newest_first()).limit(n).select(*LABEL_COLUMNS)


def markdown_label_items(t: Tables, stage: int, n: int = 20) -> DataFrame:
    """Newest items in stock at a markdown stage."""
    return (
        t.items.filter(in_stock() & (F.col("markdown_stage") == stage))
        .orderBy(*newest_first()).limit(n).select(*LABEL_COLUMNS)
    )
