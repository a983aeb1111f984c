"""Checks of stored values against the lists the entry forms offer. They report; nothing is enforced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackwise.functions import fixed_values as fixed

_ITEM_LISTS = {
    "acquisition_type": fixed.ACQUISITION_TYPES,
    "category": fixed.CATEGORIES,
    "gender": fixed.GENDERS,
    "fit": fixed.FITS,
    "condition": fixed.CONDITIONS,
    "channel_listed": fixed.CHANNELS,
}
_SALE_LISTS = {"channel": fixed.CHANNELS, "payment_method": fixed.PAYMENT_METHODS}


def _with_checks(df: DataFrame, lists: dict[str, list[str]]) -> DataFrame:
    return df.withColumns({f"{c}_known": F.coalesce(F.col(c).isin(values), F.lit(False)) for c, values in lists.items()})


def check_items(items: DataFrame) -> DataFrame:
    """Items with a flag per listed column, ``<column>_known``: false for a missing or other value."""
    return _with_checks(items, _ITEM_LISTS)


def check_sales(sales: DataFrame) -> DataFrame:
    return _with_checks(sales, _SALE_LISTS)
