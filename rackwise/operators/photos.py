"""Photo coverage, work lists, the inventory of photo files and what does not match it."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rackwise.functions import fixed_values as fixed
from rackwise.functions.columns import has_photo, in_stock, no_photo, rate_percent
from rackwise.functions.dates import at_most_old
from rackwise.sources.tables import Tables


def photo_stats(t: Tables) -> DataFrame:
    """Items in stock with and without photos, and both in percent of the stock."""
    return stats_report(t.items.filter(in_stock()).agg(
        F.count("*").alias("total_items"), F.count_if(has_photo()).alias("with_photos"), F.count_if(no_photo()).alias("without_photos")
    ))


def stats_report(sums: DataFrame) -> DataFrame:
    total = F.col("total_items")
    return sums.withColumns({
        "with_pct": rate_percent(F.col("with_photos"), total),
        "without_pct": rate_percent(F.col("without_photos"), total),
    })


def _coverage(t: Tables) -> DataFrame:
    sums = t.items.filter(in_stock()).groupBy("category").agg(F.count("*").alias("total"), F.count_if(has_photo()).alias("with_photos"))
    return with_coverage(sums)


def with_coverage(sums: DataFrame) -> DataFrame:
    return sums.withColumn("coverage_pct", rate_percent(F.col("with_photos"), F.col("total")))


def worst_first() -> list[Column]:
    return [F.col("coverage_pct").asc(), F.col("total").desc(), F.col("category").asc()]


def photo_coverage(t: Tables) -> DataFrame:
    """Photo coverage of the stock by category, worst first."""
    return _coverage(t).orderBy(*worst_first())


def low_photo_coverage(t: Tables, min_total: int = 3, below_pct: float = 50) -> DataFrame:
    return low_coverage(_coverage(t), min_total, below_pct)


def low_coverage(coverage: DataFrame, min_total: int, below_pct: float) -> DataFrame:
    low = (F.col("total") >= min_total) & (F.col("coverage_pct") < below_pct)
    return coverage.filter(low).orderBy(*worst_first())


def photo_worklist(
    t: Tables, priority: str = "all", as_of: dt.date | None = None, max_age: int = 30, min_price: float = 50,
    categories: list[str] | None = None,
) -> DataFrame:
    """Items in stock without photos to be photographed.

    ``all`` and ``high_value`` list the dearest first, ``new`` (needs ``as_of``) the newest first,
    ``categories`` goes by category, then price.
    """
    items = t.items.filter(in_stock() & no_photo())
    price = F.col("list_price").desc()
    if priority == "all":
        chosen, order = items, [price]
    elif priority == "new":
        if as_of is None:
            raise ValueError("the list of new items needs as_of")
        chosen, order = items.filter(at_most_old("listed_at", as_of, max_age)), [F.col("listed_at").desc()]
    elif priority == "high_value":
        chosen, order = items.filter(F.col("list_price") >= min_price), [price]
    elif priority == "categories":
        wanted = fixed.PHOTO_CATEGORIES if categories is None else categories
        chosen, order = items.filter(F.col("category").isin(wanted)), [F.col("category").asc(), price]
    else:
        raise ValueError(f"unknown priority {priority!r}")
    return chosen.orderBy(*order, "sku").select("sku", "category", "brand", "size", "list_price")


def photo_list_report(worklist: DataFrame) -> DataFrame:
    """A work list under its report headings, ready for CSV."""
    return worklist.select(*[F.col(c).alias(heading) for c, heading in fixed.PHOTO_LIST_HEADINGS.items()])


def photo_inventory(paths: DataFrame, root: str = "photos") -> DataFrame:
    """Photo files per SKU folder, from a ``path`` column: how many, and which comes first.

    Counts files right inside ``<root>/<sku>/``. Other endings, and endings in capitals, are no
    photos. The first is the first by name among the preferred ending present.
    """
    tail = F.regexp_extract("path", f"(?:^|/){re.escape(root.strip('/'))}/([^/]+/[^/]+)$", 1)
    file = F.substring_index("_tail", "/", -1)
    preference = F.coalesce(*[F.when(F.endswith(file, F.lit(f".{e}")), F.lit(i)) for i, e in enumerate(fixed.PHOTO_EXTENSIONS)])
    # What is no photo is dropped after counting: a filter before would take every path apart twice.
    return (
        paths.select(tail.alias("_tail"))
        .select(F.substring_index("_tail", "/", 1).alias("sku"), preference.alias("_preference"), file.alias("file"))
        .groupBy("sku").agg(
            F.count("_preference").alias("n_files"),
            F.min(F.when(F.col("_preference").isNotNull(), F.struct("_preference", "file"))).getField("file").alias("first_file"),
        )
        .filter(F.col("n_files") > 0)
    )


def stamp_photos(items: DataFrame, inventory: DataFrame, root: str = "photos") -> DataFrame:
    """Set ``photos_url`` to the SKU's folder for items that have photo files."""
    found = inventory.select("sku", F.concat(F.lit(f"{root}/"), F.col("sku")).alias("_folder"))
    return items.join(found, "sku", "left").select(*[
        F.coalesce("_folder", items[c]).alias(c) if c == "photos_url" else items[c] for c in items.columns
    ])


def _orphans(t: Tables, inventory: DataFrame) -> DataFrame:
    active = t.items.filter(F.col("active") == 1).select("sku")
    return inventory.join(active, "sku", "left_anti").select(F.col("sku").alias("folder"))


def orphan_photo_folders(t: Tables, inventory: DataFrame) -> DataFrame:
    """Photo folders that belong to no active item. Sold items count as active."""
    return _orphans(t, inventory).orderBy("folder")


def orphan_photo_summary(t: Tables, inventory: DataFrame, shown: int = 10) -> DataFrame:
    """One row: the number of orphan folders, the first few by name, and how many are not shown."""
    # Count and first names come from one pass: each partition gives its count and its own first few.
    # The names are spread by hash, so all tasks work, and the rows that meet in the end are few.
    by_partition = Window.partitionBy("_part").orderBy("folder")
    spread = _orphans(t, inventory).withColumn("_part", F.spark_partition_id())
    placed = spread.withColumn("_place", F.row_number().over(by_partition))
    each = placed.groupBy("_part").agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("_place") <= shown, F.col("folder"))).alias("_names"))
    total = F.coalesce(F.sum("n"), F.lit(0).cast("bigint"))
    both = each.agg(total.alias("orphan_folders"), F.slice(F.array_sort(F.flatten(F.collect_list("_names"))), 1, shown).alias("_first"))
    return both.select(
        "orphan_folders",
        F.array_join("_first", ", ").alias("first_folders"),
        F.greatest(F.col("orphan_folders") - F.lit(shown), F.lit(0).cast("bigint")).alias("not_shown"),
    )
