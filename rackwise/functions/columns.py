"""Column expressions shared by the operators. All of them stay inside whole-stage codegen.

Money is held as DOUBLE in the tables. Wherever it is rounded it goes through an exact DECIMAL, so
half cents round up everywhere. Wherever it is summed it is counted in whole ten-thousandths, so a
sum does not depend on the order in which partitions are merged. Whole numbers are used there
because per-row DECIMAL sums take three times as long as the rest of the aggregate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from rackwise.functions import fixed_values as fixed

MONEY_UNIT = 10_000

_WHITESPACE = " \t\n\r\f\v"


def in_stock() -> Column:
    return (F.col("active") == 1) & F.col("sold_at").isNull()


def has_photo() -> Column:
    return F.col("photos_url").isNotNull() & (F.col("photos_url") != "")


def no_photo() -> Column:
    return F.col("photos_url").isNull() | (F.col("photos_url") == "")


def money(column: str | Column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,4)")


def money_units(column: str | Column) -> Column:
    """Money in whole ten-thousandths."""
    return F.floor((F.col(column) if isinstance(column, str) else column) * MONEY_UNIT + 0.5)


def net_units() -> Column:
    """Sale price less discount in ten-thousandths; a missing discount counts as zero."""
    return money_units("sale_price") - F.coalesce(money_units("discount_value"), F.lit(0).cast("bigint"))


def total(units: str | Column, unit: int = MONEY_UNIT) -> Column:
    """Aggregate: the sum of whole money units, as money. Wide enough for any number of rows."""
    return F.sum((F.col(units) if isinstance(units, str) else units).cast("decimal(20,0)")).cast("double") / unit


def rounded(value: Column, digits: int = 2) -> Column:
    """Round a decimal half up and give it back as a double."""
    return F.round(value, digits).cast("double")


def _by_stage(stage: Column, values: dict, other: Column) -> Column:
    first, *rest = values.items()
    chain = F.when(stage == first[0], F.lit(first[1]))
    return reduce(lambda so_far, pair: so_far.when(stage == pair[0], F.lit(pair[1])), rest, chain).otherwise(other)


def percent_off_fraction(stage: str | Column = "markdown_stage") -> Column:
    stage = F.col(stage) if isinstance(stage, str) else stage
    return _by_stage(stage, fixed.MARKDOWN_SCHEDULE, F.lit("0.00")).cast("decimal(3,2)")


def exact_markdown_price(list_price: str | Column = "list_price", stage: str | Column = "markdown_stage") -> Column:
    return money(list_price) * (F.lit(1).cast("decimal(3,2)") - percent_off_fraction(stage))


def stock_value(stage: str | Column = "markdown_stage") -> Column:
    """Aggregate: the sum of unrounded markdown prices."""
    percent_left = F.lit(100) - (percent_off_fraction(stage) * 100).cast("int")
    return total(money_units("list_price") * percent_left, MONEY_UNIT * 100)


def markdown_price(
    list_price: str | Column = "list_price", stage: str | Column = "markdown_stage", rounded_to_cents: bool = True
) -> Column:
    """Price after the stage's markdown; an unknown stage leaves the list price."""
    price = exact_markdown_price(list_price, stage)
    return rounded(price) if rounded_to_cents else price.cast("double")


def percent_off(stage: str | Column = "markdown_stage") -> Column:
    """Whole percent taken off, NULL where nothing is."""
    percent = (percent_off_fraction(stage) * 100).cast("int")
    return F.when(percent > 0, percent)


def stage_name(stage: str | Column = "markdown_stage", style: str = "long") -> Column:
    """Stage description: ``long`` and ``short`` fall back to a catch-all name, ``percent`` to NULL."""
    stage = F.col(stage) if isinstance(stage, str) else stage
    if style == "percent":
        return _by_stage(stage, fixed.STAGE_PERCENT, F.lit(None).cast("string"))
    names = {"long": fixed.STAGE_LONG, "short": fixed.STAGE_SHORT}[style]
    return _by_stage(stage, names, F.lit(fixed.STAGE_OTHER))


def price_text(exact_price: Column) -> Column:
    """``R$ 12.50`` from a decimal price."""
    return F.concat(F.lit(fixed.PRICE_TEXT), F.round(exact_price, 2).cast("decimal(18,2)").cast("string"))


def item_title() -> Column:
    """``category brand size`` with blanks for missing parts, trimmed."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in ("category", "brand", "size")]
    return strip(F.concat_ws(" ", *parts))


def zero_padded(number: Column, width: int) -> Column:
    """A whole number with leading zeros; longer numbers keep all digits."""
    digits = number.cast("string")
    return F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0"))


def strip(column: Column) -> Column:
    return F.btrim(column, F.lit(_WHITESPACE))


def rate_percent(part: Column, whole: Column) -> Column:
    """``part`` of ``whole`` in percent, one decimal; NULL where ``whole`` is zero."""
    return F.round(part * F.lit(100.0) / F.nullif(whole, F.lit(0).cast("bigint")), 1)
