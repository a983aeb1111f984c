"""Reports from stored sums: the rows of the direct reports, no sales read, refreshes equal to a rebuild."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rackwise.operators import abc, kpis, rollups, sales_reports
from rackwise.sources import store
from rackwise.sources.sample_shop import SampleShop
from rackwise.sources.tables import load_tables

FOLDER = "/root/testdata/sf0.001"
PERIODS = [(dt.date(2001, 6, 15), dt.date(2001, 7, 15)), (dt.date(1998, 11, 3), dt.date(2001, 2, 1)), (dt.date(2030, 1, 1), dt.date(2030, 2, 1))]


@pytest.fixture(scope="module")
def shop(spark, tmp_path_factory):
    """A store, its tables, and its sums."""
    path, sums = (str(tmp_path_factory.mktemp("rolled") / n) for n in ("store", "sums"))
    store.create_store(SampleShop(spark, FOLDER).tables(), path)
    t = load_tables(spark, path)
    rollups.create_rollups(t, sums)
    return path, t, sums


def same(got, want):
    return got.columns == want.columns and [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


@pytest.mark.parametrize("start,end", PERIODS)
def test_the_rows_of_the_direct_reports(spark, shop, start, end):
    _, t, sums = shop
    r = rollups.load_rollups(spark, sums)
    assert same(rollups.rolled_kpis(r, start, end, t.items), kpis.kpis(t, start, end))
    assert same(rollups.rolled_revenue_by_category(r, start, end), sales_reports.revenue_by_category(t, start, end))
    assert same(rollups.rolled_performance_by_stage(r, start, end), sales_reports.performance_by_stage(t, start, end))
    assert same(rollups.rolled_top_consignors(r, start, end, t.consignors), sales_reports.top_consignors(t, start, end))
    assert same(rollups.rolled_payouts(r, start, end, t.consignors), sales_reports.payouts(t, start, end))
    assert same(rollups.rolled_abc_analysis(r, start, end), abc.abc_analysis(t, start, end))
    limits = {"days": 400, "min_sold": 2, "max_mean_days": 500}
    assert same(rollups.rolled_high_demand(r, end, **limits), sales_reports.high_demand(t, end, **limits))


def test_no_sales_are_read(spark, shop):
    path, t, sums = shop
    r, (start, end) = rollups.load_rollups(spark, sums), PERIODS[0]
    for df in (rollups.rolled_kpis(r, start, end, t.items), rollups.rolled_payouts(r, start, end, t.consignors), rollups.rolled_abc_analysis(r, start, end)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert f"{path}/sales" not in plan and "customer_name" not in plan
        assert "PartitionFilters: [isnotnull(month_of_row" in plan


def stored_sums(spark, folder):
    r = rollups.load_rollups(spark, folder)
    return [sorted(map(tuple, df.collect()), key=repr) for df in (r.groups, r.owners)]


def test_a_refresh_equals_a_rebuild(spark, make_shop, tmp_path):
    items = [{"sku": f"S{k}", "category": "AB"[k % 2], "size": "M", "markdown_stage": 0, "listed_at": f"2025-0{1 + k}-03"} for k in range(5)]
    sales = [{"id": f"V{k}", "sku": f"S{k % 6}", "date": f"2025-0{1 + k % 7}-1{k % 9}", "sale_price": None if k == 3 else 10.5 * k, "discount_value": None if k % 2 else 1.0,
              "consignor_id": None if k % 4 == 0 else f"C{k % 3}"} for k in range(40)]
    shop, path, sums, whole = make_shop(items=items, sales=sales), *(str(tmp_path / n) for n in ("store", "sums", "whole"))
    store.create_store(shop, path)
    rollups.create_rollups(shop, sums)
    changes = spark.createDataFrame([("V1", dt.date(2025, 9, 9), "S1", 99.0), ("new", dt.date(2025, 2, 2), "S9", 5.0)], "id string, date date, sku string, sale_price double")
    touched = store.upsert_by_month(spark, path, "sales", changes)
    assert rollups.refresh_rollups(spark, path, sums, touched.months) == ["2025-02", "2025-09"]
    gone = store.delete_by_month(spark, path, "sales", shop.sales.where(F.month("date") == 7).select("id"))
    moved = spark.createDataFrame([("S4", "C"), ("none", "C")], "sku string, category string")
    store.upsert_by_month(spark, path, "items", moved)
    summed = rollups.refresh_rollups(spark, path, sums, gone.months, changed_items=moved)
    assert "2025-07" in gone.emptied and {row[0] for row in shop.sales.where("sku = 'S4'").select(F.date_format("date", "yyyy-MM")).collect()} - {"2025-07"} <= {*summed}
    rollups.create_rollups(load_tables(spark, path), whole)
    assert stored_sums(spark, sums) == stored_sums(spark, whole)
    assert rollups.refresh_rollups(spark, path, sums, []) == []
