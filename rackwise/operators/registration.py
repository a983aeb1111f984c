"""Registering a batch of sales: validation, ids, consignor stamp, and the sold mark on items."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackwise.operators.ids import assign_sale_ids
from rackwise.operators.intake import blank, fill_missing, split_by_reason
from rackwise.operators.merge import last_per_key
from rackwise.sources.schema import DEFAULTS, SALES


class Registration:
    """A batch of new sales (date, sku, sale_price, discount_value, channel ...) in ``order_by`` order.

    A sale needs a SKU, a positive price, an existing item and, where ids count within its own month,
    a date. Columns that the batch lacks take the table's defaults. A sale keeps the consignor the item has
    now. An item takes date, price and channel from the last sale of it in the batch. Selling an
    item twice is allowed, and so is a discount above the price.

    Each result is built when first asked for: the rejects and the items need no sale ids.
    """

    def __init__(
        self, items: DataFrame, sales: DataFrame, new: DataFrame, order_by: Sequence[str],
        as_of: dt.date | None = None, month_of: str | None = None,
    ) -> None:
        self._old_items, self._old_sales = items, sales
        self._order_by, self._as_of, self._month_of = order_by, as_of, month_of

        missing = {f.name for f in SALES if f.name not in new.columns}
        new = fill_missing(new, SALES, DEFAULTS["sales"])
        known = items.select(F.col("sku").alias("_item_sku"), F.col("consignor_id").alias("_item_consignor"))
        stamped = new.drop("id", "consignor_id").join(known, F.col("sku") == F.col("_item_sku"), "left")
        reason = (
            F.when(blank("sku"), F.lit("SKU is required"))
            .when(F.col("sale_price").isNull() | (F.col("sale_price") <= 0), F.lit("sale price must be positive"))
            .when(F.lit(month_of is not None and as_of is None) & F.col(month_of or "date").isNull(), F.lit("date is required"))
        )
        unknown = F.when(F.col("_item_sku").isNull(), F.lit("SKU not found"))
        self._checked = split_by_reason(stamped.withColumn("reject_reason", F.coalesce(reason, unknown)))
        # The items need no check that the item exists: a sale of an unknown SKU meets none.
        self._sound = new.filter(F.coalesce(reason, F.lit(None).cast("string")).isNull())
        self._filled = [c for c in missing if c not in ("id", "consignor_id")]

    @cached_property
    def rejected(self) -> DataFrame:
        """The sales not taken, with ``reject_reason``."""
        return self._checked.rejected.drop("_item_sku", "_item_consignor", *self._filled)

    @cached_property
    def _valid(self) -> DataFrame:
        return self._checked.accepted.drop("_item_sku").withColumnRenamed("_item_consignor", "consignor_id")

    @cached_property
    def accepted(self) -> DataFrame:
        """The sales taken, with their new ids and ``net_value``."""
        numbered = assign_sale_ids(
            self._old_sales, self._valid, as_of=self._as_of, order_by=self._order_by, month_of=self._month_of
        )
        return numbered.select(*[
            F.col(f.name).cast(f.dataType).alias(f.name) if f.name in numbered.columns
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in SALES
        ], (F.col("sale_price") - F.col("discount_value")).alias("net_value"))

    @cached_property
    def sales(self) -> DataFrame:
        """All sales after the batch. Fresh ids cannot meet an old row, so no join is needed."""
        return self._old_sales.unionByName(self.accepted.drop("net_value"))

    @cached_property
    def items(self) -> DataFrame:
        """All items after the batch. The batch is folded to its last sale per SKU before the one join."""
        last = last_per_key(
            self._sound.select("sku", *self._order_by, F.col("date").alias("_sold_at"), F.col("sale_price").alias("_sale_price"),
                               F.col("channel").alias("_channel_sold")),
            "sku", self._order_by,
        ).select("sku", "_sold_at", "_sale_price", "_channel_sold", F.lit(True).alias("_sold"))
        marked = {"sold_at": "_sold_at", "sale_price": "_sale_price", "channel_sold": "_channel_sold"}
        old = self._old_items
        return old.join(last, "sku", "left").select(*[
            F.when(F.col("_sold"), F.col(marked[c])).otherwise(old[c]).alias(c) if c in marked else old[c] for c in old.columns
        ])


def register_sales(
    items: DataFrame, sales: DataFrame, new: DataFrame, order_by: Sequence[str],
    as_of: dt.date | None = None, month_of: str | None = None,
) -> Registration:
    """Register a batch of sales. Ids count within the month of ``as_of``, or of column ``month_of``."""
    return Registration(items, sales, new, order_by, as_of, month_of)
