"""All reports on the stock from one pass over the items.

One grouping by four sets (all, category, category and size, stage) counts everything the reports
show. Its few rows are stored, and each report is a selection from them.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rackwise.functions.columns import has_photo, in_stock, no_photo, stock_value
from rackwise.functions.dates import older_than
from rackwise.functions.fixed_values import PENDING_LABEL
from rackwise.operators import inventory, kpis, markdown, photos
from rackwise.sources.tables import Tables
from rackwise.sources.workspace import stored

_COLUMNS = ["category", "size", "markdown_stage"]
_SETS = {"all": [], "category": ["category"], "category_size": ["category", "size"], "stage": ["markdown_stage"]}


def stock_sums(
    t: Tables, as_of: dt.date, old_days: int = 90, ageing_days: int = 60, slow_days: int = 60, slow_below_stage: int = 2
) -> DataFrame:
    """Counts of the stock for each grouping set, told apart by ``grouped`` (the grouping's id), in one aggregate."""
    slow = older_than("listed_at", as_of, slow_days) & (F.col("markdown_stage") < slow_below_stage)
    due = markdown.label_due(as_of)
    flags = t.items.filter(in_stock()).select(
        *_COLUMNS, F.col("markdown_stage").alias("stage"), "list_price", has_photo().alias("photo"), no_photo().alias("bare"),
        markdown.steps_due(as_of).alias("due"), older_than("listed_at", as_of, old_days).alias("old"),
        older_than("listed_at", as_of, ageing_days).alias("ageing"), slow.alias("slow"), due.alias("label"),
    )
    labels = [F.count_if(F.col("label") == label).alias(f"label_{stage}") for stage, label in PENDING_LABEL.items()]
    # The value goes by an item's own stage, also where stages are grouped together.
    value = stock_value(F.col("stage")).alias("value")
    return flags.groupingSets([[F.col(c) for c in columns] for columns in _SETS.values()], *_COLUMNS).agg(
        F.grouping_id(*_COLUMNS).alias("grouped"), F.count("*").alias("qty"), value, F.count_if("photo").alias("with_photos"),
        F.count_if("bare").alias("without_photos"), F.count_if("due").alias("due"), F.count_if("old").alias("old"),
        F.count_if("ageing").alias("ageing"), F.count_if("slow").alias("slow"), *labels,
    )


class Dashboard:
    """The stock reports of one day; the items are read once, when it is made."""

    def __init__(self, t: Tables, as_of: dt.date) -> None:
        self.sums = stored(stock_sums(t, as_of), "stock-sums")

    def _of(self, name: str) -> DataFrame:
        # A column that a set groups by is a 0 in the id, the first column being the highest place.
        bits = "".join("0" if c in _SETS[name] else "1" for c in _COLUMNS)
        return self.sums.filter(F.col("grouped") == int(bits, 2))

    def _total(self, count: str, name: str) -> DataFrame:
        return self._of("all").select(F.coalesce(F.max(count), F.lit(0).cast("bigint")).alias(name))

    def photo_stats(self) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        sums = {"total_items": "qty", "with_photos": "with_photos", "without_photos": "without_photos"}
        return photos.stats_report(self._of("all").agg(*[F.coalesce(F.max(c), zero).alias(name) for name, c in sums.items()]))

    def markdown_pending(self) -> DataFrame:
        return self._total("due", "markdown_pending")

    def old_items(self) -> DataFrame:
        return self._total("old", "old_items")

    def overstocked_categories(self, over: int = 20) -> DataFrame:
        return self._of("category").filter((F.col("qty") > over) & F.col("category").isNotNull()).agg(F.count("*").alias("overstocked_categories"))

    def action_summary(self, min_old_items: int = 10, overstock: int = 20) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        return kpis.action_report(self._of("category").agg(
            F.coalesce(F.sum("due"), zero).alias("pending"), F.coalesce(F.sum("old"), zero).alias("old"),
            F.count_if((F.col("qty") > overstock) & F.col("category").isNotNull()).alias("overstocked"),
        ), min_old_items)

    def stock_by_stage(self) -> DataFrame:
        return inventory.stages_report(self._of("stage").withColumnRenamed("value", "current_value"))

    def slow_movers(self, n: int = 5) -> DataFrame:
        slow = self._of("category").filter("slow > 0").select("category", F.col("slow").alias("qty"))
        return slow.orderBy(F.col("qty").desc(), "category").limit(n)

    def stock_gaps(self, below: int = 3, n: int = 10) -> DataFrame:
        few = self._of("category_size").filter(F.col("qty") < below).select("category", "size", F.col("qty").alias("current_stock"))
        return few.orderBy("current_stock", "category", "size").limit(n)

    def pending_markdowns(self) -> DataFrame:
        each = F.array(*[F.struct(F.lit(label).alias("update_needed"), F.col(f"label_{stage}").alias("qty")) for stage, label in PENDING_LABEL.items()])
        counts = self._of("all").select(F.inline(each)).filter("qty > 0")
        return counts.orderBy(F.col("qty").desc(), "update_needed")

    def pending_total(self) -> DataFrame:
        every = sum((F.col(f"label_{stage}") for stage in PENDING_LABEL), F.lit(0).cast("bigint"))
        return self._of("all").select(F.coalesce(F.max(every), F.lit(0).cast("bigint")).alias("pending_total"))

    def category_ageing(self, over: int = 5) -> DataFrame:
        return self._ageing(over).orderBy(*inventory.oldest_first())

    def problem_categories(self, over_pct: float = 50, over: int = 5) -> DataFrame:
        return self._ageing(over).filter(F.col("old_pct") > over_pct).orderBy(*inventory.oldest_first())

    def _ageing(self, over: int) -> DataFrame:
        return inventory.with_ageing(self._of("category").select("category", F.col("qty").alias("total_items"), F.col("ageing").alias("old_items")), over)

    def photo_coverage(self) -> DataFrame:
        return self._coverage().orderBy(*photos.worst_first())

    def low_photo_coverage(self, min_total: int = 3, below_pct: float = 50) -> DataFrame:
        return photos.low_coverage(self._coverage(), min_total, below_pct)

    def _coverage(self) -> DataFrame:
        return photos.with_coverage(self._of("category").select("category", F.col("qty").alias("total"), "with_photos"))


REPORTS: dict[str, Callable[[Dashboard], DataFrame]] = {
    name: getattr(Dashboard, name) for name in (
        "photo_stats", "markdown_pending", "old_items", "overstocked_categories", "action_summary", "stock_by_stage", "slow_movers",
        "stock_gaps", "pending_markdowns", "pending_total", "category_ageing", "problem_categories", "photo_coverage", "low_photo_coverage",
    )
}
