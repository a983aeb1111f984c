"""What the plans must and must not contain."""

import datetime as dt
import re

import pytest

from rackwise.plans.catalogue import QUERIES
from rackwise.operators import inventory, kpis, labels, listings, markdown, photos, sales_reports
from rackwise.sources.tables import bucketed_tables, load_tables, save_bucketed, write_tables

FOLDER = "/root/testdata/sf0.001"
AS_OF, START, END = dt.date(2001, 7, 15), dt.date(2001, 6, 15), dt.date(2001, 7, 15)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df):
    return [line for line in plan(df).splitlines() if "FileScan" in line]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    from rackwise.sources.sample_shop import SampleShop

    folder = str(tmp_path_factory.mktemp("shop") / "tables")
    write_tables(SampleShop(spark, FOLDER).tables(), folder)
    return load_tables(spark, folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert not re.search(r"Python|Pandas|Arrow|CartesianProduct|BroadcastNestedLoopJoin", text)


def test_date_ranges_reach_the_scan(stored):
    (scan,) = [s for s in scans(sales_reports.revenue_by_category(stored, START, END)) if "discount_value" in s]
    assert "GreaterThanOrEqual(date,2001-06-15)" in scan and "LessThanOrEqual(date,2001-07-15)" in scan


def test_ages_reach_the_scan(stored):
    (scan,) = scans(kpis.old_items(stored, AS_OF))
    assert "LessThan(listed_at,2001-04-16)" in scan and "EqualTo(active,1)" in scan and "IsNull(sold_at)" in scan
    (scan,) = scans(photos.photo_worklist(stored, "new", AS_OF))
    assert "GreaterThanOrEqual(listed_at,2001-06-15)" in scan


def test_only_needed_columns_are_read(stored):
    (scan,) = scans(inventory.category_ageing(stored, AS_OF))
    assert re.search(r"ReadSchema: struct<category:string,listed_at:date,sold_at:date,active:int>", scan)


def test_markdown_and_labels_are_narrow(stored):
    for df in (markdown.apply_markdowns(stored.items, AS_OF), labels.label_manifest(stored.items)):
        assert "Exchange" not in plan(df)


def test_top_lists_sort_no_more_than_they_show(stored):
    for df in (listings.very_slow_items(stored, AS_OF), listings.recent_stock(stored), listings.fast_movers(stored, START, END),
               sales_reports.top_consignors(stored, START, END), inventory.stock_gaps(stored)):
        assert "TakeOrderedAndProject" in plan(df)


def test_sales_are_folded_before_the_join(stored):
    for df in (sales_reports.revenue_by_category(stored, START, END), sales_reports.performance_by_stage(stored, START, END),
               sales_reports.high_demand(stored, AS_OF), inventory.sell_through_matrix(stored, START, END)):
        # The first thing done above the scan of sales is the partial aggregate.
        lines = plan(df).splitlines()
        scan = next(i for i, line in enumerate(lines) if "FileScan" in line and re.search(r"ReadSchema: struct<date:date,sku:string", line))
        above = next(line for line in reversed(lines[:scan]) if not re.search(r"Filter|Project|ColumnarToRow|FileScan|Scan", line))
        assert "partial_" in above


def test_bucketed_tables_join_without_a_shuffle(spark, stored, tmp_path):
    save_bucketed(stored, str(tmp_path), "loja", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        bucketed = bucketed_tables(spark, "loja")
        for build in (lambda t: sales_reports.revenue_by_category(t, START, END), lambda t: inventory.sell_through_matrix(t, START, END)):
            assert "hashpartitioning(sku" in re.sub(r"#\d+L?", "", plan(build(stored)))
            assert "hashpartitioning(sku" not in re.sub(r"#\d+L?", "", plan(build(bucketed)))
            assert build(bucketed).collect() == build(stored).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("consignors", "items", "sales"):
            spark.sql(f"DROP TABLE IF EXISTS loja_{name}")


def test_a_hot_sku_and_rows_without_consignor_are_split(spark, tmp_path):
    """A third of the sales on one SKU, in tables too large to broadcast: the join's hot partition is split."""
    from pyspark.sql import functions as F

    from rackwise.sources.schema import ITEMS, SALES
    from rackwise.sources.tables import Tables

    n = 60000
    conf = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "16",
    }
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        def complete(df, schema):
            return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])

        items = complete(spark.range(n).select(F.col("id").cast("string").alias("sku"), F.lit("x").alias("category")), ITEMS)
        sales = complete(spark.range(0, n, 1, 16).select(
            F.col("id").cast("string").alias("id"), F.when(F.col("id") % 3 == 0, "7").otherwise(F.col("id").cast("string")).alias("sku"),
            F.lit(AS_OF).alias("date"), F.lit(1.0).alias("sale_price"), F.uuid().alias("notes"), F.uuid().alias("customer_name")), SALES)
        items.write.parquet(str(tmp_path / "items"))
        sales.write.parquet(str(tmp_path / "sales"))
        t = Tables(None, spark.read.parquet(str(tmp_path / "items")), spark.read.parquet(str(tmp_path / "sales")))
        history = listings.sales_history(t)
        assert history.count() == n
        result = history.select("id", "category")
        result.collect()
        assert "skew=true" in plan(result) or "skewed" in plan(result)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_periods_open_only_their_months(spark, tmp_path):
    from rackwise.sources.sample_shop import SampleShop

    shop, folder = SampleShop(spark, FOLDER).tables(), str(tmp_path / "tables")
    write_tables(shop, folder)
    whole, part = load_tables(spark, folder), load_tables(spark, folder, sold=(START, END), listed=(START, END))
    for name, df in shop.named().items():
        assert whole.named()[name].columns == df.columns
        assert sorted(map(str, whole.named()[name].collect())) == sorted(map(str, df.collect()))
    (scan,) = scans(part.sales.filter("sku <> ''"))
    assert re.search(r"PartitionFilters: \[isnotnull\(month_of_row#\d+\), \(month_of_row#\d+ >= 2001-06\), \(month_of_row#\d+ <= 2001-07\)\]", scan)
    months = {r[0] for r in part.sales.selectExpr("date_format(date, 'yyyy-MM')").distinct().collect()}
    assert months == {"2001-06", "2001-07"} and part.items.filter("listed_at IS NULL").count() == 0
    assert whole.items.filter("listed_at IS NULL").count() > 0
    both = [sales_reports.payouts(t, START, END).collect() for t in (whole, part)]
    assert both[0] == both[1] and both[0]


def test_registered_reports_push_the_sale_date(spark):
    for name in ("revenue_by_category", "payouts", "top_consignors", "abc_analysis", "kpis"):
        assert any("GreaterThanOrEqual(l_shipdate" in s or "l_shipdate" in s and "DataFilters: [" in s for s in scans(QUERIES[name](spark, FOLDER))), name


def test_upsert_reads_its_target_once(stored, spark):
    from rackwise.operators.merge import upsert

    changes = spark.createDataFrame([("1", 5.0)], "sku string, list_price double")
    assert len(scans(upsert(stored.items, changes, "sku"))) == 1


def test_views_of_the_session_survive(spark, stored):
    from rackwise.sources.tables import run_sql

    spark.range(3).createOrReplaceTempView("items")
    assert run_sql(spark, stored, "SELECT count(*) AS n FROM items").first()["n"] > 3
    assert spark.table("items").columns == ["id"] and "sales" not in [v.name for v in spark.catalog.listTables() if v.isTemporary]
    spark.catalog.dropTempView("items")


def test_pivot_keeps_sizes_it_was_not_told(make_shop):
    rows = [{"sku": f"{i}", "category": "x", "size": s, "list_price": 1.0, "listed_at": "2001-06-20"} for i, s in enumerate(["M", "M", "XL", "XL", None, None])]
    shop = make_shop(items=rows, sales=[])
    assert inventory.sell_through_pivot(shop, START, END).columns == ["category", "M", "XL", "null"]
    assert inventory.sell_through_pivot(shop, START, END, [None, "M"]).columns == ["category", "null", "M"]


def test_registered_items_meet_a_folded_batch_in_one_join(stored):
    from rackwise.operators.registration import register_sales

    batch = stored.sales.select("date", "sku", "sale_price", "channel", "notes").withColumnRenamed("notes", "turn")
    lines = plan(register_sales(stored.items, stored.sales, batch, ["turn"], month_of="date").items).splitlines()
    joins = [i for i, line in enumerate(lines) if "Join" in line]
    assert len(joins) == 1 and len([line for line in lines if "FileScan" in line]) == 2
    # The batch is an aggregate by SKU when it gets there, so a hot SKU is one row.
    assert any("partial_max" in line for line in lines[joins[0]:])
