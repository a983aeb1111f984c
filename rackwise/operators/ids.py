"""Ids for new rows, counting on from the highest existing one.

Only well-formed ids are counted, by number and not by text, so ``C10000`` follows ``C9999`` and a
stray id cannot send the counter back to one. A counter of more than 18 digits is no well-formed id.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackwise.functions.columns import zero_padded
from rackwise.functions.dates import day_of
from rackwise.functions.fixed_values import CONSIGNOR_ID, SALE_ID, SKU
from rackwise.operators.numbering import number_rows


def _pattern(form: tuple[str, str, int], by_month: bool) -> str:
    """A well-formed id: the month, if any, is group 1 and the counter the last group."""
    before, between, _ = form
    month = r"(\d{4})" if by_month else ""
    return "^" + before + month + between + r"(\d{1,18})$"


def assign_consignor_ids(existing: DataFrame, new: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Give each new consignor the next ``C0001``-style ``id``, in ``order_by`` order."""
    last = (
        existing.select(F.regexp_extract("id", _pattern(CONSIGNOR_ID, by_month=False), 1).alias("_number")).filter("_number <> ''")
        .agg(F.coalesce(F.max(F.col("_number").cast("bigint")), F.lit(0)).alias("_last"))
    )
    numbered = number_rows(new.drop("id"), order_by, name="_no")
    number = F.col("_no") + last.scalar()
    return numbered.select(F.concat(F.lit(CONSIGNOR_ID[0]), zero_padded(number, CONSIGNOR_ID[2])).alias("id"), *_others(numbered))


def assign_skus(
    existing: DataFrame, new: DataFrame, as_of: dt.date | None = None, order_by: Sequence[str] = (), month_of: str | None = None
) -> DataFrame:
    """Give each new item the next ``BH-YYMM-0001``-style ``sku`` of its month.

    The month is that of ``as_of`` for the whole batch, or of the date column ``month_of`` per row;
    with both, ``as_of`` stands in where a row has no date. A row without any month fails the run.
    """
    return _assign_by_month(existing, new, "sku", SKU, as_of, order_by, month_of)


def assign_sale_ids(
    existing: DataFrame, new: DataFrame, as_of: dt.date | None = None, order_by: Sequence[str] = (), month_of: str | None = None
) -> DataFrame:
    """Give each new sale the next ``VYYMM001``-style ``id`` of its month; months as for SKUs."""
    return _assign_by_month(existing, new, "id", SALE_ID, as_of, order_by, month_of)


def _last_by_month(existing: DataFrame, id_column: str, form: tuple[str, str, int]) -> DataFrame:
    """Highest counter per month: one row for each month in use."""
    pattern = _pattern(form, by_month=True)
    return (
        existing.filter(F.col(id_column).rlike(pattern))
        .groupBy(F.regexp_extract(id_column, pattern, 1).alias("_month"))
        .agg(F.max(F.regexp_extract(id_column, pattern, 2).cast("bigint")).alias("last"))
    )


def _assign_by_month(
    existing: DataFrame, new: DataFrame, id_column: str, form: tuple[str, str, int],
    as_of: dt.date | None, order_by: Sequence[str], month_of: str | None,
) -> DataFrame:
    if as_of is None and month_of is None:
        raise ValueError("give as_of or month_of")
    days = ([F.col(month_of)] if month_of is not None else []) + ([F.lit(day_of(as_of))] if as_of is not None else [])
    month = F.date_format(F.coalesce(*days), "yyMM")
    missing = F.raise_error(F.lit(f"a row has no date to take the month of its {id_column} from"))
    dated = new.drop(id_column).withColumn("_month", F.when(month.isNull(), missing).otherwise(month))
    numbered = number_rows(dated, order_by, group_by=["_month"], name="_no", after=_last_by_month(existing, id_column, form))
    before, between, width = form
    new_id = F.concat(F.lit(before), F.col("_month"), F.lit(between), zero_padded(F.col("_no"), width))
    return numbered.select(new_id.alias(id_column), *_others(numbered))


def _others(numbered: DataFrame) -> list[Column]:
    return [numbered[c] for c in numbered.columns if c not in ("_no", "_month")]
