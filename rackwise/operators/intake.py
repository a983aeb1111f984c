"""Intake of new consignors and items in batches, with validation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackwise.functions.columns import markdown_price
from rackwise.functions.fixed_values import DEFAULT_PERCENT
from rackwise.sources.schema import CONSIGNORS, ITEMS

_RESET_WHEN_SAVED = ("sold_at", "sale_price", "channel_sold", "days_on_hand")


@dataclass(frozen=True)
class Intake:
    """Accepted rows in table form; rejected rows as they came, with ``reject_reason``."""

    accepted: DataFrame
    rejected: DataFrame


def split_by_reason(checked: DataFrame) -> Intake:
    return Intake(
        accepted=checked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        rejected=checked.filter(F.col("reject_reason").isNotNull()),
    )


def blank(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) == "")


def _with_columns(df: DataFrame, *needed: str) -> DataFrame:
    """With the columns that the checks look at, NULL where the batch has none."""
    return df.withColumns({c: F.lit(None).cast("string") for c in needed if c not in df.columns})


def _as_they_came(rejected: DataFrame, new: DataFrame) -> DataFrame:
    return rejected.select(*new.columns, "reject_reason")


def fill_missing(df: DataFrame, schema, values: dict) -> DataFrame:
    """All columns of ``schema`` that ``df`` lacks, from ``values`` or NULL."""
    missing = {f.name: F.lit(values.get(f.name)).cast(f.dataType) for f in schema if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def _in_table_form(df: DataFrame, schema, *extra: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema], *extra)


def intake_consignors(new: DataFrame) -> Intake:
    """The name is required. Share and active flag default to one half and active if not supplied."""
    checked = split_by_reason(_with_columns(new, "name").withColumn("reject_reason", F.when(blank("name"), F.lit("name is required"))))
    filled = fill_missing(checked.accepted, CONSIGNORS, {"percent": DEFAULT_PERCENT, "active": 1})
    return Intake(_in_table_form(filled, CONSIGNORS), _as_they_came(checked.rejected, new))


def intake_items(new: DataFrame) -> Intake:
    """Category and a positive list price are required; a saved item counts as unsold again.

    Accepted rows carry ``current_price``, the price at their markdown stage.
    """
    reason = F.when(blank("category"), F.lit("category is required")).when(
        F.col("list_price").isNull() | (F.col("list_price") <= 0), F.lit("list price must be positive")
    )
    checked = split_by_reason(_with_columns(new, "category", "list_price").withColumn("reject_reason", reason))
    accepted = fill_missing(checked.accepted, ITEMS, {"cost": 0.0, "markdown_stage": 0, "active": 1}).withColumns({
        "consignor_id": F.nullif(F.trim("consignor_id"), F.lit("")),
        **{c: F.lit(None) for c in _RESET_WHEN_SAVED},
        "current_price": markdown_price(),
    })
    return Intake(_in_table_form(accepted, ITEMS, "current_price"), _as_they_came(checked.rejected, new))
