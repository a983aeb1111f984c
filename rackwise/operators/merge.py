"""Batch upsert and delete by key."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def last_per_key(changes: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """The last row of each key in ``order_by`` order; full ties fall to the largest remaining values.

    An aggregate rather than a window: each task first folds its own rows to one per key, so a key
    that fills a third of the batch still shuffles only one row per task.
    """
    payload = [c for c in changes.columns if c != key and c not in order_by]
    if not payload and not order_by:
        return changes.distinct()
    row = F.max(F.struct(*order_by, *payload)).alias("_row")
    return changes.groupBy(key).agg(row).select(*[F.col(key) if c == key else F.col(f"_row.{c}") for c in changes.columns])


def split_keyless(changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Changes that name a key, and those that do not and so can't be applied."""
    return changes.filter(F.col(key).isNotNull()), changes.filter(F.col(key).isNull())


def upsert(
    target: DataFrame,
    changes: DataFrame,
    key: str,
    update_cols: Sequence[str] | None = None,
    order_by: Sequence[str] = (),
    defaults: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Insert changes with a new key; overwrite the supplied columns where the key exists.

    A supplied NULL overwrites too. Columns an inserted row does not supply take ``defaults``, else
    NULL. With several changes per key the last in ``order_by`` order counts; columns used only
    for ordering need not exist in ``target``. A change without a key fails the run; take such
    changes out with ``split_keyless`` first.

    One full outer join: the target is read once, the batch folded once.
    """
    return upsert_folded(target, folded(changes, key, order_by), key, update_cols, defaults)


def folded(changes: DataFrame, key: str, order_by: Sequence[str] = ()) -> DataFrame:
    """:func:`last_per_key` of changes that all have a key; one without fails the run."""
    must = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"a change has no {key}"))).otherwise(F.col(key))
    return last_per_key(changes.withColumn(key, must), key, order_by)


def upsert_folded(target: DataFrame, last: DataFrame, key: str, update_cols: Sequence[str] | None = None, defaults: Mapping[str, Any] | None = None) -> DataFrame:
    """:func:`upsert` of a batch that is folded already, and so holds each key once."""
    supplied = [c for c in last.columns if c != key and c in target.columns]
    updated = supplied if update_cols is None else [c for c in supplied if c in update_cols]
    change = last.select(F.col(key).alias("_new_key"), *[F.col(c).alias(f"_new_{c}") for c in supplied])
    old = target.withColumn("_old", F.lit(True))

    def value(c: str) -> Column:
        if c == key:
            return F.coalesce(old[c], F.col("_new_key").cast(target.schema[c].dataType)).alias(c)
        new = F.col(f"_new_{c}") if c in supplied else F.lit((defaults or {}).get(c))
        new = new.cast(target.schema[c].dataType)
        if c in updated:
            return F.when(F.col("_new_key").isNotNull(), new).otherwise(old[c]).alias(c)
        return F.when(F.col("_old"), old[c]).otherwise(new).alias(c)

    return old.join(change, old[key] == F.col("_new_key"), "full_outer").select(*[value(c) for c in target.columns])


def delete_keys(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Drop the rows whose key is listed; an unknown or NULL key does nothing."""
    return target.join(keys.select(key).distinct(), key, "left_anti")
