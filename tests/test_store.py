"""Tables changed month by month: same rows as whole-table changes, other months' files neither opened nor written."""

import datetime as dt
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from rackwise.functions.fixed_values import MARKDOWN_AGES
from rackwise.operators import listings, markdown, merge
from rackwise.sources import store
from rackwise.sources.schema import DEFAULTS
from rackwise.sources.tables import load_table, write_table

AS_OF = dt.date(2025, 8, 15)


def files(folder, name="items"):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in Path(folder, name).rglob("*.parquet")}


def months_in(paths):
    return {store._month_in(p) for p in paths}


def scanned(spark, df, metric):
    """A figure of the file scans of a query once it is run: ``numFiles`` opened, ``numOutputRows`` given out."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = df.select("*")
        df.collect()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        scans = [leaves.apply(i) for i in range(leaves.size())]
        return sum(s.metrics().apply(metric).value() for s in scans if "Scan" in s.nodeName() and s.metrics().contains(metric))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def opens_only(spark, folder, df, months):
    return scanned(spark, df, "numFiles") == sum(1 for f in files(folder) if months_in([f]) <= {*months})


@pytest.fixture
def shop(make_shop):
    items = [{"sku": f"S{m:02}{k:02}", "category": "AB"[k % 2], "listed_at": f"2025-{m:02}-{5 + k:02}", "markdown_stage": 0} for m in range(1, 9) for k in range(6)]
    items += [{"sku": f"U{k}", "listed_at": None} for k in range(3)]
    sales = [{"id": f"V{k}", "sku": f"S01{k:02}", "date": f"2025-0{1 + k}-20", "sale_price": 10.0} for k in range(6)]
    return make_shop(items=items, sales=sales)


@pytest.fixture
def folder(shop, tmp_path):
    store.create_store(shop, str(tmp_path / "store"), buckets=4)
    return str(tmp_path / "store")


def rows(df):
    return sorted((tuple(r) for r in df.select("sku", "category", "listed_at", "list_price", "markdown_stage", "active").collect()), key=repr)


def test_a_store_reads_like_the_tables(spark, shop, folder):
    assert rows(load_table(spark, folder, "items")) == rows(shop.items)
    assert store.store_months(spark, folder, "items") == [f"2025-{m:02}" for m in range(8, 0, -1)] + [None]
    assert store.store_months(spark, folder, "sales") == [f"2025-0{m}" for m in range(6, 0, -1)]


def test_an_upsert_touches_its_months_only(spark, shop, folder):
    changes = spark.createDataFrame([("S0301", 50.0, 1), ("S0301", 60.0, 2), ("S0502", None, 1)], "sku string, list_price double, n int")
    before = files(folder)
    touched = store.upsert_by_month(spark, folder, "items", changes, order_by=["n"], defaults=DEFAULTS["items"])
    assert touched.months == ["2025-05", "2025-03"] and touched.emptied == []
    after = files(folder)
    same = {f for f in before if months_in([f]) & {"2025-03", "2025-05"} == set()}
    assert all(after[f] == before[f] for f in same) and months_in(set(after) - same) == {"2025-03", "2025-05"}
    assert rows(load_table(spark, folder, "items")) == rows(merge.upsert(shop.items, changes, "sku", order_by=["n"], defaults=DEFAULTS["items"]))
    assert opens_only(spark, folder, store.load_months(spark, folder, "items", touched.months), touched.months)


def test_rows_move_between_months_and_leave_none_behind(spark, shop, folder):
    day = dt.date(2025, 12, 1)
    moved = [(f"S02{k:02}", day) for k in range(6)] + [("U0", dt.date(2025, 1, 9)), ("S0400", None), ("new", day), ("none", None)]
    changes = spark.createDataFrame(moved, "sku string, listed_at date")
    touched = store.upsert_by_month(spark, folder, "items", changes, defaults=DEFAULTS["items"])
    assert touched.months == ["2025-12", "2025-04", "2025-02", "2025-01", None] and touched.emptied == ["2025-02"]
    want = merge.upsert(shop.items, changes, "sku", defaults=DEFAULTS["items"])
    assert rows(load_table(spark, folder, "items")) == rows(want)
    assert "2025-02" not in store.store_months(spark, folder, "items")
    again = spark.createDataFrame([("S0200", 7.0), ("new", 8.0)], "sku string, list_price double")
    assert "2025-12" in store.upsert_by_month(spark, folder, "items", again).months  # the directory knows the new place
    assert rows(load_table(spark, folder, "items")) == rows(merge.upsert(want, again, "sku"))
    fresh = spark.createDataFrame([("fresh", 1.0)], "sku string, list_price double")
    assert store.upsert_by_month(spark, folder, "items", fresh).months == [None]


def test_changes_without_a_key_or_of_nothing(spark, folder):
    before = files(folder)
    empty = spark.createDataFrame([], "sku string, list_price double")
    assert store.upsert_by_month(spark, folder, "items", empty) == store.Touched()
    assert store.delete_by_month(spark, folder, "items", spark.createDataFrame([("x",), (None,)], "sku string")) == store.Touched()
    with pytest.raises(Exception, match="a change has no sku"):
        store.upsert_by_month(spark, folder, "items", spark.createDataFrame([(None, 1.0)], "sku string, list_price double"))
    assert files(folder) == before


def test_deletes_touch_their_months_only(spark, shop, folder):
    keys = spark.createDataFrame([(f"S06{k:02}",) for k in range(6)] + [("S0801",), ("U1",), ("U1",)], "sku string")
    before = files(folder)
    touched = store.delete_by_month(spark, folder, "items", keys)
    assert touched.months == ["2025-08", "2025-06", None] and touched.emptied == ["2025-06"]
    assert rows(load_table(spark, folder, "items")) == rows(merge.delete_keys(shop.items, keys, "sku"))
    after = files(folder)
    assert all(after[f] == at for f, at in before.items() if not months_in([f]) & {*touched.months})
    sold = store.delete_by_month(spark, folder, "sales", spark.createDataFrame([("V2",)], "id string"))
    assert sold.emptied == ["2025-03"] and load_table(spark, folder, "sales").count() == 5


def test_a_look_up_opens_the_key_s_month_and_skips_row_groups(spark, make_shop, tmp_path):
    path = str(tmp_path / "large")
    store.create_store(make_shop(items=[{"sku": f"K{k:05}", "listed_at": f"2025-0{1 + k % 3}-0{1 + k % 7}"} for k in range(3000)]), path)
    keys = spark.createDataFrame([("K00004",), ("K00007",), ("gone",), (None,)], "sku string")
    found = store.rows_by_key(spark, path, "items", keys)
    assert sorted(r["sku"] for r in found.collect()) == ["K00004", "K00007"]
    months = store.months_of_keys(spark, path, "items", keys.select(F.col("sku").alias("key")))
    assert months == ["2025-02"] and opens_only(spark, path, found, months)
    month = store.load_months(spark, path, "items", months)
    assert scanned(spark, month, "numOutputRows") == 1000
    # A key within the range of the month's keys: only a Bloom filter tells that no row group holds it.
    assert scanned(spark, month.where("sku = 'K00500x'"), "numOutputRows") == 0
    joined = store.rows_by_key(spark, path, "items", keys, most=1)
    assert sorted(r["sku"] for r in joined.collect()) == ["K00004", "K00007"]


def test_the_newest_come_from_the_newest_months(spark, shop, folder):
    assert opens_only(spark, folder, store.newest_items(spark, folder, 7), ["2025-08", "2025-07"])
    for n, wanted in ((1, "true"), (7, "true"), (4, "category = 'A'"), (500, "true"), (3, "listed_at is null")):
        t = store.newest_tables(spark, folder, n, wanted)
        got = [tuple(r) for r in listings.recent_stock(t, n).collect()]
        whole = [tuple(r) for r in listings.recent_stock(type(shop)(shop.consignors, shop.items.where(wanted), shop.sales), n).collect()]
        assert got == whole
    tied = spark.createDataFrame([(f"T{k}", dt.date(2025, 8, 31)) for k in range(9)], "sku string, listed_at date")
    store.upsert_by_month(spark, folder, "items", tied, defaults=DEFAULTS["items"])
    got = [r["sku"] for r in listings.recent_stock(store.newest_tables(spark, folder, 5), 5).collect()]
    assert got == ["T8", "T7", "T6", "T5", "T4"] and opens_only(spark, folder, store.newest_items(spark, folder, 5), ["2025-08"])


def test_months_due_hold_every_item_that_comes_of_age():
    for last, days in ((dt.date(2025, 8, 1), 1), (dt.date(2025, 7, 10), 36), (dt.date(2024, 2, 28), 400), (AS_OF, 0)):
        as_of = last + dt.timedelta(days=days)
        want = set()
        for age in MARKDOWN_AGES.values():
            for back in range(days):
                want.add(f"{as_of - dt.timedelta(days=age + 1 + back):%Y-%m}")
        assert store.months_due(last, as_of) == sorted(want)


def test_two_runs_of_markdowns_equal_one(spark, shop, tmp_path):
    last, path = dt.date(2025, 8, 1), str(tmp_path / "runs")
    first = type(shop)(shop.consignors, markdown.apply_markdowns(shop.items, last), shop.sales)
    store.create_store(first, path)
    before = files(path)
    touched = store.markdown_by_month(spark, path, last, AS_OF)
    assert rows(load_table(spark, path, "items")) == rows(markdown.apply_markdowns(shop.items, AS_OF))
    assert {*touched.months} <= {*store.months_due(last, AS_OF)} == {"2025-05", "2025-06", "2025-07"}
    after = files(path)
    assert all(after[f] == at for f, at in before.items() if not months_in([f]) & {*touched.months})
    late = spark.createDataFrame([("late", dt.date(2025, 1, 2), 1.0)], "sku string, listed_at date, list_price double")
    store.upsert_by_month(spark, path, "items", late, defaults=DEFAULTS["items"])
    store.markdown_by_month(spark, path, AS_OF, AS_OF, changed=late)
    assert load_table(spark, path, "items").where("sku = 'late'").first()["markdown_stage"] == 3
    assert os.path.isdir(path) and load_table(spark, path, "items").where(F.col("sku") == "S0800").first()["markdown_stage"] == 0


def test_rows_are_computed_once_to_be_written_and_changed(spark, shop, tmp_path, folder):
    def counted(df, column):
        seen = spark.sparkContext.accumulator(0)

        def note(value):
            seen.add(1)
            return value

        return df.withColumn(column, F.udf(note)(column)), seen

    items, seen = counted(shop.items, "sku")
    write_table(items, str(tmp_path / "once"), "items")
    assert seen.value == shop.items.count()  # no sample of the rows is taken first
    shared = Path(spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    stored, in_store = {*shared.glob("rackwise-*")}, {p.name for p in Path(folder).iterdir()}
    changes = spark.createDataFrame([("S0301", dt.date(2025, 7, 1)), ("new", None)], "sku string, listed_at date")
    store.upsert_by_month(spark, folder, "items", changes, defaults=DEFAULTS["items"])
    # Only the batch is stored on the way; months and directory are written where they are to be.
    assert [p.name.split("-")[1] for p in {*shared.glob("rackwise-*")} - stored] == ["changes"]
    assert {p.name for p in Path(folder).iterdir()} == in_store


def test_new_rows_are_known_by_a_date_that_old_ones_do_not_take(spark, shop, folder):
    changes = spark.createDataFrame([("S0301", dt.date(2025, 7, 1), 5.0), ("new", dt.date(2026, 1, 1), 6.0)], "sku string, listed_at date, list_price double")
    store.upsert_by_month(spark, folder, "items", changes, ["list_price"], defaults=DEFAULTS["items"])
    assert rows(load_table(spark, folder, "items")) == rows(merge.upsert(shop.items, changes, "sku", ["list_price"], defaults=DEFAULTS["items"]))
    keys = spark.createDataFrame([("S0301",), ("new",)], "key string")
    assert store.months_of_keys(spark, folder, "items", keys) == ["2026-01", "2025-03"]
