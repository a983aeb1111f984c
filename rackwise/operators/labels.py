"""Print manifest for price labels: the texts of each label and its place on a sheet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackwise.functions import fixed_values as fixed
from rackwise.functions.columns import exact_markdown_price, money, price_text
from rackwise.operators.numbering import number_rows


def label_manifest(items: DataFrame, small: bool = True) -> DataFrame:
    """Label texts per item. ``small`` labels split a long description over two lines.

    The list price appears only on items with a markdown stage above 0.
    """
    described = items.withColumn(
        "description", F.concat_ws(" ", "category", F.nullif("brand", F.lit("")), F.nullif("size", F.lit("")))
    )
    words = F.split(F.trim("description"), r"\s+")
    split_here = (F.length("description") > fixed.SMALL_LABEL_CHARACTERS) if small else F.lit(False)
    rest = F.array_join(F.slice(words, fixed.SMALL_LABEL_WORDS + 1, F.greatest(F.size(words), F.lit(1))), " ")
    return described.select(
        "sku",
        "description",
        F.when(split_here, F.array_join(F.slice(words, 1, fixed.SMALL_LABEL_WORDS), " ")).otherwise(F.col("description")).alias("line1"),
        F.when(split_here, F.nullif(rest, F.lit(""))).alias("line2"),
        F.concat(F.lit(fixed.CONDITION_TEXT), F.coalesce("condition", F.lit(""))).alias("condition_text"),
        price_text(exact_markdown_price()).alias("price_text"),
        F.when(F.col("markdown_stage") > 0, F.concat(F.lit("("), price_text(money("list_price")), F.lit(")"))).alias("original_price_text"),
    )


def label_sheet(
    items: DataFrame, cols: int = fixed.SHEET_2X4[0], rows: int = fixed.SHEET_2X4[1], order_by: Sequence[str] = ("sku",),
    first_sheet_only: bool = False,
) -> DataFrame:
    """Place labels on sheets, left to right, then down: add ``slot``, ``sheet``, ``col``, ``row``.

    ``first_sheet_only`` drops what does not fit on one sheet. Otherwise further sheets follow, and
    the slots are numbered across tasks, so a print run may be of any size.
    """
    per_sheet = cols * rows
    if first_sheet_only:
        items = items.orderBy(*order_by).limit(per_sheet)
    numbered = number_rows(items, order_by, name="_no")
    slot = F.col("_no") - 1
    in_sheet = slot % per_sheet
    return numbered.select(
        *items.columns,
        slot.alias("slot"),
        F.floor(slot / per_sheet).alias("sheet"),
        (in_sheet % cols).alias("col"),
        F.floor(in_sheet / cols).alias("row"),
    )
