"""Upsert, delete, id assignment, intake and registration on hand-made rows."""

import datetime as dt

import pytest
from conftest import rows, table
from pyspark.sql import functions as F

from rackwise.operators import ids
from rackwise.operators.intake import intake_consignors, intake_items
from rackwise.operators.merge import delete_keys, split_keyless, upsert
from rackwise.operators.numbering import number_rows
from rackwise.operators.registration import register_sales
from rackwise.sources.schema import DEFAULTS

AS_OF = dt.date(2025, 8, 31)


def by_id(df, *columns):
    return {r["id"]: tuple(r[c] for c in columns) for r in df.collect()}


def people(make_table):
    return make_table("consignors", [
        {"id": "C0001", "name": "Ana", "email": "a@x", "percent": 0.4}, {"id": "C0002", "name": "Bia", "percent": None}])


def test_upsert_updates_inserts_and_keeps(spark, make_table):
    changes = spark.createDataFrame(
        [("C0002", "Beatriz", 1), ("C0002", "Bea", 2), ("C0003", "Caio", 1), (None, "ninguém", 1)], "id string, name string, seq int")
    with pytest.raises(Exception, match="a change has no id"):
        upsert(people(make_table), changes, "id", order_by=["seq"]).collect()
    keyed, keyless = split_keyless(changes, "id")
    assert rows(keyless) == [(None, "ninguém", 1)]
    merged = upsert(people(make_table), keyed, "id", order_by=["seq"], defaults=DEFAULTS["consignors"])
    assert by_id(merged, "name", "email", "percent", "active") == {
        "C0001": ("Ana", "a@x", 0.4, 1), "C0002": ("Bea", None, None, 1), "C0003": ("Caio", None, 0.5, 1)}
    assert merged.columns == people(make_table).columns


def test_upsert_supplied_null_overwrites(spark, make_table):
    changes = spark.createDataFrame([("C0001", None)], "id string, email string")
    assert by_id(upsert(people(make_table), changes, "id"), "name", "email")["C0001"] == ("Ana", None)


def test_upsert_limited_columns_still_insert_whole_rows(spark, make_table):
    changes = spark.createDataFrame([("C0001", "x", "n1"), ("C0009", "y", "n9")], "id string, name string, notes string")
    merged = by_id(upsert(people(make_table), changes, "id", update_cols=["notes"]), "name", "notes")
    assert merged == {"C0001": ("Ana", "n1"), "C0002": ("Bia", None), "C0009": ("y", "n9")}


def test_upsert_twice_is_once_and_delete_is_undone(spark, make_table):
    target = people(make_table)
    changes = spark.createDataFrame([("C0002", "Bea"), ("C0003", "Caio")], "id string, name string")
    once = upsert(target, changes, "id")
    assert sorted(rows(upsert(once, changes, "id"))) == sorted(rows(once))
    removed = delete_keys(target, changes, "id")
    assert by_id(removed, "name") == {"C0001": ("Ana",)}
    assert sorted(rows(upsert(removed, target, "id"))) == sorted(rows(target))


def test_delete_of_missing_repeated_and_null_keys(spark, make_table):
    keys = spark.createDataFrame([("C0001",), ("C0001",), ("C7777",), (None,)], "id string")
    assert by_id(delete_keys(people(make_table), keys, "id"), "name") == {"C0002": ("Bia",)}


def test_hot_key_batch(spark, make_table):
    """Many changes of one key, the last of them first in the data."""
    changes = spark.range(20000, 0, -1).select(F.lit("C0001").alias("id"), F.concat(F.lit("n"), "id").alias("name"), F.col("id").alias("seq"))
    assert by_id(upsert(people(make_table), changes, "id", order_by=["seq"]), "name")["C0001"] == ("n20000",)


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_number_rows_with_a_hot_group(spark, groups):
    """Two thirds of the rows in one group, a NULL group, ties in the first order column."""
    df = spark.range(5000).select(
        "id", F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 2 == 0, F.concat(F.lit("g"), F.col("id") % 7)).alias("g"),
        (F.col("id") % 5).alias("tied")).repartition(16)
    got = number_rows(df, ["tied", "id"], groups, name="no").collect()
    assert len(got) == 5000
    by_group = {}
    for r in sorted(got, key=lambda r: (r["tied"], r["id"])):
        key = r["g"] if groups else None
        by_group[key] = by_group.get(key, 0) + 1
        assert r["no"] == by_group[key]


def test_number_rows_spreads_one_group_over_tasks(spark):
    """One group, no other key: the placed rows still lie in several partitions of similar size."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(100000).select("id", F.lit("only").alias("g"))
        numbered = number_rows(df, ["id"], ["g"]).withColumn("p", F.spark_partition_id())
        sizes = [r["count"] for r in numbered.groupBy("p").count().collect()]
        assert sum(sizes) == 100000 and len(sizes) == 8 and max(sizes) < 20000
        assert numbered.filter(F.col("row_no") != F.col("id") + 1).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_consignor_ids(spark, make_table):
    existing = make_table("consignors", [{"id": i, "name": "x"} for i in ("C0002", "C0007", "Cabc", "X0009")])
    new = spark.createDataFrame([("z", 2), ("y", 1)], "name string, seq int")
    got = {r["name"]: r["id"] for r in ids.assign_consignor_ids(existing, new, ["seq"]).collect()}
    assert got == {"y": "C0008", "z": "C0009"}
    none = make_table("consignors", [])
    assert {r["id"] for r in ids.assign_consignor_ids(none, new, ["seq"]).collect()} == {"C0001", "C0002"}


def test_consignor_ids_pass_four_digits(spark, make_table):
    existing = make_table("consignors", [{"id": i, "name": "x"} for i in ("C9999", "C10000")])
    new = spark.createDataFrame([("y", 1)], "name string, seq int")
    assert ids.assign_consignor_ids(existing, new, ["seq"]).first()["id"] == "C10001"


def test_skus_and_sale_ids_count_by_month(spark, make_table):
    items = make_table("items", [{"sku": s} for s in ("BH-2508-0003", "BH-2508-0001", "BH-2507-0044", "BH-2508-x", "outro")])
    new = spark.createDataFrame([("a", 1), ("b", 2)], "name string, seq int")
    got = {r["name"]: r["sku"] for r in ids.assign_skus(items, new, as_of=AS_OF, order_by=["seq"]).collect()}
    assert got == {"a": "BH-2508-0004", "b": "BH-2508-0005"}
    later = ids.assign_skus(items, new, as_of=dt.date(2025, 9, 1), order_by=["seq"])
    assert {r["sku"] for r in later.collect()} == {"BH-2509-0001", "BH-2509-0002"}
    sales = make_table("sales", [{"id": s, "date": "2025-08-01", "sku": "q", "sale_price": 1.0} for s in ("V2508999", "V2508998", "V2507001")])
    got = {r["name"]: r["id"] for r in ids.assign_sale_ids(sales, new, as_of=AS_OF, order_by=["seq"]).collect()}
    assert got == {"a": "V25081000", "b": "V25081001"}
    dated = spark.createDataFrame([(dt.date(2025, 7, 9), 1), (dt.date(2025, 10, 1), 2)], "date date, seq int")
    assert {r["id"] for r in ids.assign_sale_ids(sales, dated, order_by=["seq"], month_of="date").collect()} == {"V2507002", "V2510001"}
    with pytest.raises(ValueError):
        ids.assign_skus(items, new, order_by=["seq"])


def test_consignor_intake(spark):
    new = spark.createDataFrame([("Ana", True), ("", True), (None, False), (" ", False)], "name string, active boolean")
    taken = intake_consignors(new)
    assert [(r["name"], r["percent"], r["active"]) for r in taken.accepted.collect()] == [("Ana", 0.5, 1), (" ", 0.5, 0)]
    assert [r["reject_reason"] for r in taken.rejected.collect()] == ["name is required"] * 2
    kept = intake_consignors(spark.createDataFrame([("Ana", None)], "name string, percent double")).accepted
    assert kept.first()["percent"] is None and kept.first()["active"] == 1


def test_item_intake(spark):
    new = spark.createDataFrame(
        [("1", "C0001", "Bolsa", 10.0, 1, "2025-01-01"), ("2", "", "Bolsa", 5.0, 0, None), ("3", "C0001", "", 5.0, 0, None),
         ("4", "C0001", "Bolsa", 0.0, 0, None), ("5", "C0001", "Bolsa", None, 0, None)],
        "sku string, consignor_id string, category string, list_price double, markdown_stage int, sold_at string")
    taken = intake_items(new)
    got = {r["sku"]: (r["consignor_id"], r["sold_at"], r["current_price"], r["active"], r["cost"]) for r in taken.accepted.collect()}
    assert got == {"1": ("C0001", None, 9.0, 1, 0.0), "2": (None, None, 5.0, 1, 0.0)}
    reasons = {r["sku"]: r["reject_reason"] for r in taken.rejected.collect()}
    assert reasons == {"3": "category is required", "4": "list price must be positive", "5": "list price must be positive"}


def test_registration(spark, make_table):
    items = make_table("items", [
        {"sku": "a", "consignor_id": "C0001", "list_price": 9.0}, {"sku": "b", "sold_at": "2025-01-01", "sale_price": 3.0, "channel_sold": "Loja"},
        {"sku": "c"}])
    sales = make_table("sales", [{"id": "V2508004", "date": "2025-08-01", "sku": "a", "sale_price": 1.0}])
    new = spark.createDataFrame(
        [(1, "2025-08-20", "a", 10.0, 1.0, "Loja"), (2, "2025-08-10", "a", 8.0, 12.0, "Online"), (3, "2025-08-21", "b", 4.0, None, "Pix"),
         (4, "2025-08-22", "zz", 5.0, 0.0, "Loja"), (5, "2025-08-22", "", 5.0, 0.0, "Loja"), (6, "2025-08-22", "a", 0.0, 0.0, "Loja")],
        "seq int, date string, sku string, sale_price double, discount_value double, channel string",
    ).withColumn("date", F.col("date").cast("date"))
    done = register_sales(items, sales, new, ["seq"], as_of=AS_OF)
    assert by_id(done.accepted, "sku", "net_value", "consignor_id") == {
        "V2508005": ("a", 9.0, "C0001"), "V2508006": ("a", -4.0, "C0001"), "V2508007": ("b", None, None)}
    assert done.sales.count() == 4 and done.sales.columns == sales.columns
    marked = {r["sku"]: (str(r["sold_at"]), r["sale_price"], r["channel_sold"]) for r in done.items.collect()}
    # The last registered sale marks the item, even with an earlier date; "b" is sold a second time.
    assert marked == {"a": ("2025-08-10", 8.0, "Online"), "b": ("2025-08-21", 4.0, "Pix"), "c": ("None", None, None)}
    assert {r["seq"]: r["reject_reason"] for r in done.rejected.collect()} == {
        4: "SKU not found", 5: "SKU is required", 6: "sale price must be positive"}


def test_table_helper_defaults(spark):
    assert table(spark, "items", [{"sku": "1"}]).first()["active"] == 1


def test_registration_of_odd_batches(spark, make_shop):
    shop = make_shop(items=[{"sku": "A", "consignor_id": "C1", "category": "x", "list_price": 10.0}], sales=[])
    batch = spark.createDataFrame(
        [(1, None, "A", 10.0), (2, dt.date(2025, 8, 2), "A", 20.0), (3, dt.date(2025, 8, 3), "B", 5.0)], "n int, date date, sku string, sale_price double")
    done = register_sales(shop.items, shop.sales, batch, ["n"], month_of="date")
    assert [(r.n, r.reject_reason) for r in done.rejected.orderBy("n").collect()] == [(1, "date is required"), (3, "SKU not found")]
    assert done.rejected.columns == [*batch.columns, "reject_reason"] or set(done.rejected.columns) == {*batch.columns, "reject_reason"}
    assert [(r.id, r.discount_value, r.net_value, r.channel, r.consignor_id) for r in done.accepted.collect()] == [("V2508001", 0.0, 20.0, None, "C1")]
    item, = done.items.collect()
    assert (item.sold_at, item.sale_price, item.channel_sold) == (dt.date(2025, 8, 2), 20.0, None)
    both = register_sales(shop.items, shop.sales, batch, ["n"], as_of=AS_OF, month_of="date")
    assert both.rejected.count() == 1 and both.accepted.count() == 2


def test_ids_need_a_month(spark):
    new = spark.createDataFrame([(1, None)], "n int, date date")
    none = spark.createDataFrame([], "id string")
    with pytest.raises(Exception, match="no date"):
        ids.assign_sale_ids(none, new, order_by=["n"], month_of="date").collect()
    assert ids.assign_sale_ids(none, new, as_of=AS_OF, order_by=["n"], month_of="date").first()["id"] == "V2508001"
