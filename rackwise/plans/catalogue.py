"""The registered queries: each reads the source tables in a folder and returns one DataFrame."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rackwise.functions import columns as col
from rackwise.functions.dates import age_in_days
from rackwise.functions.fixed_values import SHEET_2X4, SHEET_3X6
from rackwise.operators import (
    abc, consignors, dashboard, ids, intake, inventory, kpis, labels, listings, markdown, merge, photos, quality, registration, rollups,
    sales_reports, text_index,
)
from rackwise.sources import store
from rackwise.sources.sample_shop import CHANGE_ORDER, SALE_ORDER, SampleShop
from rackwise.sources.schema import DEFAULTS, SCHEMAS
from rackwise.sources.tables import Tables, load_table, run_sql, write_csv, write_table
from rackwise.sources.workspace import new_folder

AS_OF = dt.date(2001, 7, 15)
START, END = dt.date(2001, 6, 15), dt.date(2001, 7, 15)
# The sizes that get a column; the sample shop has more.
PIVOT_SIZES = [*[str(size) for size in range(1, 46)], None]

Query = Callable[[SparkSession, str], DataFrame]


def on_shop(build: Callable[[SampleShop], DataFrame]) -> Query:
    return lambda spark, folder: build(SampleShop(spark, folder))


# --- tables, merges -------------------------------------------------------------------------


def written_and_loaded(name: str, fmt: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        path = new_folder(spark, f"tables-{fmt}")
        write_table(SampleShop(spark, folder).tables().named()[name], path, name, fmt)
        return load_table(spark, path, name, fmt)

    return run


def sql_over_tables(spark: SparkSession, folder: str) -> DataFrame:
    return run_sql(
        spark, SampleShop(spark, folder).tables(),
        """SELECT i.brand, s.channel, COUNT(*) AS n_sales, MAX(s.sale_price) AS top_price
           FROM sales s JOIN items i ON s.sku = i.sku
           WHERE s.date >= :start AND s.date <= :end AND i.condition = :condition
           GROUP BY i.brand, s.channel ORDER BY i.brand, s.channel""",
        {"start": START, "end": END, "condition": "A"},
    )


def sql_positional(spark: SparkSession, folder: str) -> DataFrame:
    return run_sql(
        spark, SampleShop(spark, folder).tables(),
        "SELECT category, COUNT(*) AS n_items FROM items WHERE listed_at >= ? AND listed_at <= ? GROUP BY category",
        [START, END],
    )


def upsert_items(t: SampleShop) -> DataFrame:
    keyed, _ = merge.split_keyless(t.item_changes, "sku")
    merged = merge.upsert(
        t.items, keyed, "sku",
        order_by=CHANGE_ORDER, defaults=DEFAULTS["items"],
    )
    return merged.select("sku", "category", "list_price", "channel_listed", "notes", "cost", "markdown_stage", "active")


def upsert_items_price_only(t: SampleShop) -> DataFrame:
    keyed, _ = merge.split_keyless(t.item_changes, "sku")
    merged = merge.upsert(
        t.items, keyed, "sku",
        update_cols=["list_price"], order_by=CHANGE_ORDER, defaults=DEFAULTS["items"],
    )
    return merged.select("sku", "list_price", "channel_listed", "notes", "active")


def keyless_changes(t: SampleShop) -> DataFrame:
    return merge.split_keyless(t.item_changes, "sku")[1].select("list_price", "channel_listed", "changed_at")


def upsert_consignors(t: SampleShop) -> DataFrame:
    """Edited consignors: the customers whose number is that of one, and newcomers beyond the last."""
    edits = t.new_consignors.select(F.format_string("C%04d", F.col("c_custkey") + 1).alias("id"), "name", "whatsapp", "active")
    return merge.upsert(t.consignors, edits, "id", defaults=DEFAULTS["consignors"]).select("id", "name", "whatsapp", "pix_key", "percent", "active")


def delete_consignors(t: SampleShop) -> DataFrame:
    return merge.delete_keys(t.consignors, t.sales.select(F.col("consignor_id").alias("id")), "id").select("id", "name", "active")


def delete_sales(t: SampleShop) -> DataFrame:
    pix = t.sales.filter(F.col("payment_method") == "Pix").select("id")
    return merge.delete_keys(t.sales, pix, "id").select("id", "date", "sku")


def delete_items(t: SampleShop) -> DataFrame:
    keys = t.item_changes.select("sku")
    return merge.delete_keys(t.items, keys, "sku").select("sku", "category", "list_price")


# --- tables changed month by month ---------------------------------------------------------------


def item_store(spark: SparkSession, folder: str) -> tuple[SampleShop, str]:
    """The sample shop, and a store of its own with its tables."""
    t, path = SampleShop(spark, folder), new_folder(spark, "store")
    store.create_store(t.tables(), path)
    return t, path


def upsert_items_by_month(spark: SparkSession, folder: str) -> DataFrame:
    t, path = item_store(spark, folder)
    keyed, _ = merge.split_keyless(t.item_changes, "sku")
    store.upsert_by_month(spark, path, "items", keyed, order_by=CHANGE_ORDER, defaults=DEFAULTS["items"])
    return load_table(spark, path, "items").select("sku", "category", "list_price", "channel_listed", "notes", "cost", "markdown_stage", "active")


def relisted_items(spark: SparkSession, folder: str) -> DataFrame:
    """Changes that list items anew, and so move them to other months."""
    t, path = item_store(spark, folder)
    relisted = t.item_changes.where("sku is not null").select("sku", "list_price", F.col("changed_at").alias("listed_at"), *CHANGE_ORDER)
    store.upsert_by_month(spark, path, "items", relisted, order_by=CHANGE_ORDER, defaults=DEFAULTS["items"])
    return load_table(spark, path, "items").select("sku", "category", "list_price", "listed_at", "active")


def delete_items_by_month(spark: SparkSession, folder: str) -> DataFrame:
    t, path = item_store(spark, folder)
    store.delete_by_month(spark, path, "items", t.item_changes.select("sku"))
    return load_table(spark, path, "items").select("sku", "category", "list_price")


def markdowns_in_two_runs(spark: SparkSession, folder: str) -> DataFrame:
    """A run over the whole table, then, twenty days later, one over the months in which an item came of age."""
    t, path = SampleShop(spark, folder), new_folder(spark, "store")
    before = AS_OF - dt.timedelta(days=20)
    first = dataclasses.replace(t.tables(), items=markdown.apply_markdowns(t.items, before))
    store.create_store(first, path)
    store.markdown_by_month(spark, path, before, AS_OF)
    return load_table(spark, path, "items").select("sku", "listed_at", "markdown_stage")


def item_lookup_by_month(spark: SparkSession, folder: str) -> DataFrame:
    t, path = item_store(spark, folder)
    return store.rows_by_key(spark, path, "items", t.item_changes.select("sku")).select("sku", "category", "list_price", "markdown_stage", "sold_at")


def newest(report: Callable[..., DataFrame], n: int, wanted: str = "true") -> Query:
    """A report on the newest items from a store, of which only the newest months are opened."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        _, path = item_store(spark, folder)
        return report(store.newest_tables(spark, path, n, wanted))

    return run


# --- reports from stored sums ---------------------------------------------------------------------


def rolled(report: Callable[[rollups.Rollups, SampleShop], DataFrame]) -> Query:
    """A report from sums of the sample shop's sales, stored first."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        t, path = SampleShop(spark, folder), new_folder(spark, "rollups")
        rollups.create_rollups(t.tables(), path)
        return report(rollups.load_rollups(spark, path), t)

    return run


def refreshed(report: Callable[[rollups.Rollups, SampleShop], DataFrame]) -> Query:
    """A report from sums that were stored before the last two months' sales came and before items were reduced, and then
    summed anew where that changed them."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        t, path, sums = SampleShop(spark, folder), new_folder(spark, "store"), new_folder(spark, "rollups")
        late = F.col("date") >= F.lit(END - dt.timedelta(days=45))
        dearer = t.items.withColumn("markdown_stage", F.when(F.col("category") == "Bolsa", 0).otherwise(F.col("markdown_stage")))
        before = Tables(t.consignors, dearer, t.sales.where(~late))
        store.create_store(before, path)
        rollups.create_rollups(before, sums)
        came = store.upsert_by_month(spark, path, "sales", t.sales.where(late))
        reduced = t.items.where("category = 'Bolsa'").select("sku", "markdown_stage")
        store.upsert_by_month(spark, path, "items", reduced)
        rollups.refresh_rollups(spark, path, sums, came.months, changed_items=reduced)
        return report(rollups.load_rollups(spark, sums), t)

    return run


def payouts_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "payouts-csv")
    report = sales_reports.payout_report(SampleShop(spark, folder), START, END)
    write_csv(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


def photo_list_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = new_folder(spark, "photo-list-csv")
    report = photos.photo_list_report(photos.photo_worklist(SampleShop(spark, folder)))
    write_csv(report, path)
    return spark.read.schema(report.schema).option("header", True).csv(path)


def photo_inventory(t: SampleShop) -> DataFrame:
    return photos.photo_inventory(t.photo_paths)


def stamp_photos(t: SampleShop) -> DataFrame:
    stamped = photos.stamp_photos(t.items, photo_inventory(t))
    return stamped.select("sku", "photos_url", "listed_at", "active")


# --- ids, intake, registration ---------------------------------------------------------------


def consignor_ids(t: SampleShop) -> DataFrame:
    new = t.new_consignors
    return ids.assign_consignor_ids(t.consignors, new, ["c_custkey"]).select("id", "c_custkey", "name")


def skus(t: SampleShop) -> DataFrame:
    """First the finished orders, then the others count on from them, month by month."""
    orders = t.new_items
    nothing = orders.select(F.lit("").alias("sku")).limit(0)
    first = ids.assign_skus(nothing, orders.filter(F.col("category") == "F"), order_by=["o_orderkey"], month_of="listed_at")
    then = ids.assign_skus(first, orders.filter(F.col("category") != "F"), order_by=["o_orderkey"], month_of="listed_at")
    return first.unionByName(then).select("sku", "o_orderkey", "listed_at")


def skus_of_one_month(t: SampleShop) -> DataFrame:
    """The whole batch enters on one day, so all of it counts in one month."""
    orders = t.new_items
    nothing = orders.select(F.lit("").alias("sku")).limit(0)
    return ids.assign_skus(nothing, orders, as_of=AS_OF, order_by=["o_orderkey"]).select("sku", "o_orderkey")


def sale_ids(t: SampleShop) -> DataFrame:
    return ids.assign_sale_ids(t.sales, t.new_sales, AS_OF, SALE_ORDER, month_of="date").select("id", "date", "sku", "sale_price")


def accepted_consignors(t: SampleShop) -> DataFrame:
    taken = intake.intake_consignors(t.new_consignors).accepted
    return taken.select("name", "whatsapp", "percent", "active")


def rejected_consignors(t: SampleShop) -> DataFrame:
    rejected = intake.intake_consignors(t.new_consignors).rejected
    return rejected.select("c_custkey", "name", "reject_reason")


def accepted_items(t: SampleShop) -> DataFrame:
    taken = intake.intake_items(t.new_items).accepted
    return taken.select(
        "consignor_id", "category", "list_price", "markdown_stage", "listed_at", "sold_at", "cost", "active", "current_price"
    )


def rejected_items(t: SampleShop) -> DataFrame:
    rejected = intake.intake_items(t.new_items).rejected
    return rejected.select("o_orderkey", "category", "list_price", "reject_reason")


def _registered(t: SampleShop) -> registration.Registration:
    return registration.register_sales(t.items, t.sales, t.new_sales, SALE_ORDER, month_of="date")


def registered_sales(t: SampleShop) -> DataFrame:
    return _registered(t).sales.select("id", "date", "sku", "sale_price", "discount_value", "channel", "consignor_id")


def registered_net_values(t: SampleShop) -> DataFrame:
    return _registered(t).accepted.select("id", "sku", "net_value", "consignor_id")


def registered_items(t: SampleShop) -> DataFrame:
    return _registered(t).items.select("sku", "sold_at", "sale_price", "channel_sold", "listed_at")


def rejected_sales(t: SampleShop) -> DataFrame:
    return _registered(t).rejected.select("date", "sku", "sale_price", "reject_reason")


# --- pricing ---------------------------------------------------------------------------------


def markdown_prices(t: SampleShop) -> DataFrame:
    return t.items.select(
        "sku", "list_price", "markdown_stage",
        col.markdown_price().alias("current_price"),
        col.markdown_price(rounded_to_cents=False).alias("current_price_unrounded"),
        col.percent_off().alias("percent_off"),
    )


def stage_names(t: SampleShop) -> DataFrame:
    return t.items.select(
        "sku",
        *[col.stage_name(style=style).alias(f"stage_{style}") for style in ("long", "short", "percent")],
    )


def payout_splits(t: SampleShop) -> DataFrame:
    """Splits of texts as they come from a form: numbers, blanks and words."""
    rows = t.items.select(
        "sku",
        F.when(F.col("condition") == "C", "sem valor").otherwise(F.col("list_price").cast("string")).alias("total_net"),
        F.when(F.col("photos_url") == "", "").otherwise("0.35").alias("percent"),
    )
    return sales_reports.payout_split(rows)


def item_ages(t: SampleShop) -> DataFrame:
    return t.items.select("sku", age_in_days("listed_at", dt.datetime(2001, 7, 15, 6, 0)).alias("age"))


def item_checks(t: SampleShop) -> DataFrame:
    checked = quality.check_items(t.items)
    return checked.select("sku", *[F.col(c).cast("int").alias(c) for c in checked.columns if c.endswith("_known")])


def sale_checks(t: SampleShop) -> DataFrame:
    checked = quality.check_sales(t.sales).groupBy("channel", "payment_method", "channel_known", "payment_method_known")
    return checked.agg(F.count("*").alias("n_sales")).withColumns({
        c: F.col(c).cast("int") for c in ("channel_known", "payment_method_known")
    })


# --- lists with a derived key set --------------------------------------------------------------


def item_lookup(t: SampleShop) -> DataFrame:
    wanted = t.item_changes.select("sku")
    return listings.item_by_sku(t, wanted).select("sku", "category", "list_price", "markdown_stage", "sold_at")


def items_with_consignor(t: SampleShop) -> DataFrame:
    return listings.with_consignor_name(t.items, t.consignors).select("sku", "consignor_id", "consignor_name")


def orphan_photo_folders(t: SampleShop) -> DataFrame:
    return photos.orphan_photo_folders(t, photo_inventory(t))


def orphan_photo_summary(t: SampleShop) -> DataFrame:
    return photos.orphan_photo_summary(t, photo_inventory(t))


def consignors_by_index(spark: SparkSession, folder: str) -> DataFrame:
    t, path = SampleShop(spark, folder), new_folder(spark, "names")
    text_index.create_text_index(t.consignors, "name", path)
    return text_index.search_consignors(t, path, "SUPPLIER#0000000")


def gallery_by_index(spark: SparkSession, folder: str) -> DataFrame:
    t, path = SampleShop(spark, folder), new_folder(spark, "brands")
    text_index.create_text_index(t.items, "brand", path)
    return text_index.gallery_by_brand(t, path, "bRAND#1", category="PROMO", with_photos=True)


# --- labels ------------------------------------------------------------------------------------


def in_stock(t: SampleShop) -> DataFrame:
    return t.items.filter(col.in_stock())


def label_sheets(t: SampleShop) -> DataFrame:
    return labels.label_sheet(in_stock(t), *SHEET_2X4, order_by=["listed_at", "sku"]).select("sku", "slot", "sheet", "col", "row")


def label_sheet_first(t: SampleShop) -> DataFrame:
    placed = labels.label_sheet(in_stock(t), *SHEET_3X6, order_by=["listed_at", "sku"], first_sheet_only=True)
    return placed.select("sku", "slot", "sheet", "col", "row")


QUERIES: dict[str, Query] = {
    **{f"load_{name}_{fmt}": written_and_loaded(name, fmt) for name in SCHEMAS for fmt in ("parquet", "csv")},
    "sql_over_tables": sql_over_tables,
    "sql_positional": sql_positional,
    "upsert_items": on_shop(upsert_items),
    "upsert_items_price_only": on_shop(upsert_items_price_only),
    "delete_items": on_shop(delete_items),
    "keyless_changes": on_shop(keyless_changes),
    "upsert_consignors": on_shop(upsert_consignors),
    "delete_consignors": on_shop(delete_consignors),
    "delete_sales": on_shop(delete_sales),
    "upsert_items_by_month": upsert_items_by_month,
    "relisted_items": relisted_items,
    "delete_items_by_month": delete_items_by_month,
    "markdowns_in_two_runs": markdowns_in_two_runs,
    "item_lookup_by_month": item_lookup_by_month,
    "newest_stock": newest(listings.recent_stock, 100),
    "newest_labels": newest(lambda t: listings.label_batch(t, AS_OF, category="SMALL", max_age=30), 10, "category = 'SMALL'"),
    "newest_markdown_labels": newest(lambda t: listings.markdown_label_items(t, 2), 20, "markdown_stage = 2"),
    "rolled_kpis": rolled(lambda r, t: rollups.rolled_kpis(r, START, END, t.items)),
    "rolled_revenue_by_category": rolled(lambda r, t: rollups.rolled_revenue_by_category(r, START, END)),
    "rolled_performance_by_stage": rolled(lambda r, t: rollups.rolled_performance_by_stage(r, START, END)),
    "rolled_high_demand": rolled(lambda r, t: rollups.rolled_high_demand(r, AS_OF, days=365, min_sold=2, max_mean_days=300)),
    "rolled_top_consignors": rolled(lambda r, t: rollups.rolled_top_consignors(r, START, END, t.consignors)),
    "rolled_payouts": rolled(lambda r, t: rollups.rolled_payouts(r, START, END, t.consignors)),
    "rolled_abc_analysis": rolled(lambda r, t: rollups.rolled_abc_analysis(r, START, END)),
    "refreshed_payouts": refreshed(lambda r, t: rollups.rolled_payouts(r, START, END, t.consignors)),
    "refreshed_performance_by_stage": refreshed(lambda r, t: rollups.rolled_performance_by_stage(r, START, END)),
    **{f"dashboard_{name}": on_shop(lambda t, report=report: report(dashboard.Dashboard(t, AS_OF))) for name, report in dashboard.REPORTS.items()},
    "abc_by_item": on_shop(lambda t: abc.abc_by_item(t, START, END)),
    "payouts_csv": payouts_csv,
    "photo_list_csv": photo_list_csv,
    "photo_inventory": on_shop(photo_inventory),
    "stamp_photos": on_shop(stamp_photos),
    "consignor_ids": on_shop(consignor_ids),
    "skus": on_shop(skus),
    "skus_of_one_month": on_shop(skus_of_one_month),
    "sale_ids": on_shop(sale_ids),
    "accepted_consignors": on_shop(accepted_consignors),
    "rejected_consignors": on_shop(rejected_consignors),
    "accepted_items": on_shop(accepted_items),
    "rejected_items": on_shop(rejected_items),
    "registered_sales": on_shop(registered_sales),
    "registered_net_values": on_shop(registered_net_values),
    "registered_items": on_shop(registered_items),
    "rejected_sales": on_shop(rejected_sales),
    "markdown_prices": on_shop(markdown_prices),
    "stage_names": on_shop(stage_names),
    "payout_splits": on_shop(payout_splits),
    "item_ages": on_shop(item_ages),
    "item_checks": on_shop(item_checks),
    "sale_checks": on_shop(sale_checks),
    "consignor_list": on_shop(listings.consignor_list),
    "consignor_cards": on_shop(listings.consignor_cards),
    "active_consignors": on_shop(listings.active_consignors),
    "search_consignors": on_shop(lambda t: listings.search_consignors(t, "SUPPLIER#0000000")),
    "search_consignors_by_index": consignors_by_index,
    "gallery_by_index": gallery_by_index,
    "items_with_consignor": on_shop(items_with_consignor),
    "stock_list": on_shop(listings.stock_list),
    "sales_history": on_shop(listings.sales_history),
    "recent_stock_photo": on_shop(lambda t: listings.recent_stock(t, variant="photo")),
    "recent_stock_label": on_shop(lambda t: listings.recent_stock(t, variant="label")),
    "item_lookup": on_shop(item_lookup),
    "gallery": on_shop(listings.gallery),
    "gallery_filtered": on_shop(lambda t: listings.gallery(t, category="PROMO", brand="bRAND#1", with_photos=True)),
    "fast_movers": on_shop(lambda t: listings.fast_movers(t, START, END)),
    "very_slow_items": on_shop(lambda t: listings.very_slow_items(t, AS_OF)),
    "photo_worklist_all": on_shop(lambda t: photos.photo_worklist(t, "all")),
    "photo_worklist_new": on_shop(lambda t: photos.photo_worklist(t, "new", AS_OF)),
    "photo_worklist_high_value": on_shop(lambda t: photos.photo_worklist(t, "high_value")),
    "photo_worklist_categories": on_shop(lambda t: photos.photo_worklist(t, "categories", categories=["PROMO", "LARGE"])),
    "label_batch": on_shop(lambda t: listings.label_batch(t, AS_OF, n=50)),
    "label_batch_filtered": on_shop(lambda t: listings.label_batch(t, AS_OF, category="SMALL", max_age=30)),
    "markdown_label_items": on_shop(lambda t: listings.markdown_label_items(t, 2)),
    "kpis": on_shop(lambda t: kpis.kpis(t, START, END)),
    "kpis_of_last_days": on_shop(lambda t: kpis.kpis(t, as_of=AS_OF)),
    "kpi_cards": on_shop(lambda t: kpis.kpi_cards(t, START, END)),
    "photo_stats": on_shop(photos.photo_stats),
    "markdown_pending": on_shop(lambda t: kpis.markdown_pending(t, AS_OF)),
    "old_items": on_shop(lambda t: kpis.old_items(t, AS_OF)),
    "overstocked_categories": on_shop(kpis.overstocked_categories),
    "action_summary": on_shop(lambda t: kpis.action_summary(t, AS_OF)),
    "payouts": on_shop(lambda t: sales_reports.payouts(t, START, END)),
    "revenue_by_category": on_shop(lambda t: sales_reports.revenue_by_category(t, START, END)),
    "sell_through_matrix": on_shop(lambda t: inventory.sell_through_matrix(t, START, END)),
    "sell_through_matrix_distinct": on_shop(lambda t: inventory.sell_through_matrix(t, START, END, distinct_items=True)),
    "sell_through_pivot": on_shop(lambda t: inventory.sell_through_pivot(t, START, END, sizes=PIVOT_SIZES)),
    "stock_by_stage": on_shop(inventory.stock_by_stage),
    "performance_by_stage": on_shop(lambda t: sales_reports.performance_by_stage(t, START, END)),
    "top_consignors": on_shop(lambda t: sales_reports.top_consignors(t, START, END)),
    "slow_movers": on_shop(lambda t: inventory.slow_movers(t, AS_OF)),
    "stock_gaps": on_shop(inventory.stock_gaps),
    "pending_markdowns": on_shop(lambda t: markdown.pending_markdowns(t, AS_OF)),
    "pending_total": on_shop(lambda t: markdown.pending_total(t, AS_OF)),
    "category_ageing": on_shop(lambda t: inventory.category_ageing(t, AS_OF)),
    "problem_categories": on_shop(lambda t: inventory.problem_categories(t, AS_OF)),
    "high_demand": on_shop(lambda t: sales_reports.high_demand(t, AS_OF)),
    "high_demand_of_a_year": on_shop(lambda t: sales_reports.high_demand(t, AS_OF, days=365, min_sold=2, max_mean_days=300)),
    "low_demand": on_shop(lambda t: inventory.low_demand(t, AS_OF)),
    "consignor_performance": on_shop(lambda t: consignors.consignor_performance(t, AS_OF)),
    "top_performers": on_shop(lambda t: consignors.top_performers(t, AS_OF)),
    "low_performers": on_shop(lambda t: consignors.low_performers(t, AS_OF)),
    "low_performers_below_all": on_shop(lambda t: consignors.low_performers(t, AS_OF, min_added=2, below_rate=100)),
    "consignor_performance_distinct": on_shop(lambda t: consignors.consignor_performance(t, AS_OF, distinct_items=True)),
    "photo_coverage": on_shop(photos.photo_coverage),
    "low_photo_coverage": on_shop(photos.low_photo_coverage),
    "abc_analysis": on_shop(lambda t: abc.abc_analysis(t, START, END)),
    "abc_summary": on_shop(lambda t: abc.abc_summary(t, START, END)),
    "orphan_photo_folders": on_shop(orphan_photo_folders),
    "orphan_photo_summary": on_shop(orphan_photo_summary),
    "apply_markdowns": on_shop(lambda t: markdown.apply_markdowns(t.items, AS_OF).select("sku", "listed_at", "markdown_stage")),
    "markdown_transitions": on_shop(lambda t: markdown.markdown_transitions(t.items, AS_OF)),
    "label_manifest": on_shop(lambda t: labels.label_manifest(in_stock(t))),
    "label_sheets": on_shop(label_sheets),
    "label_sheet_first": on_shop(label_sheet_first),
}
