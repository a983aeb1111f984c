"""The stock reports from one pass, and ABC classes of very many rows."""

import datetime as dt

import pytest

from rackwise.operators import abc, dashboard, inventory, kpis, markdown, photos
from rackwise.sources.sample_shop import SampleShop
from rackwise.sources.tables import load_tables, write_tables

FOLDER, AS_OF = "/root/testdata/sf0.001", dt.date(2001, 7, 15)
SINGLE = {
    "photo_stats": photos.photo_stats, "markdown_pending": lambda t: kpis.markdown_pending(t, AS_OF), "old_items": lambda t: kpis.old_items(t, AS_OF),
    "overstocked_categories": kpis.overstocked_categories, "action_summary": lambda t: kpis.action_summary(t, AS_OF), "stock_by_stage": inventory.stock_by_stage,
    "slow_movers": lambda t: inventory.slow_movers(t, AS_OF), "stock_gaps": inventory.stock_gaps, "pending_markdowns": lambda t: markdown.pending_markdowns(t, AS_OF),
    "pending_total": lambda t: markdown.pending_total(t, AS_OF), "category_ageing": lambda t: inventory.category_ageing(t, AS_OF),
    "problem_categories": lambda t: inventory.problem_categories(t, AS_OF), "photo_coverage": photos.photo_coverage, "low_photo_coverage": photos.low_photo_coverage,
}


def same(got, want):
    return got.columns == want.columns and [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored_shop(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shop") / "tables")
    write_tables(SampleShop(spark, FOLDER).tables(), folder)
    return folder, load_tables(spark, folder)


def test_every_report_equals_its_single_one(stored_shop):
    board = dashboard.Dashboard(stored_shop[1], AS_OF)
    assert set(SINGLE) == set(dashboard.REPORTS)
    for name, report in dashboard.REPORTS.items():
        assert same(report(board), SINGLE[name](stored_shop[1])), name


def test_odd_stocks(make_shop):
    items = [{"sku": f"S{k}", "category": None if k % 3 == 0 else "A", "size": None if k % 4 == 0 else "M", "markdown_stage": None if k % 5 == 0 else k % 6,
              "list_price": None if k % 7 == 0 else 10.05 * k, "listed_at": None if k % 6 == 0 else "2001-01-02", "photos_url": [None, "", "p"][k % 3],
              "active": [1, 1, 1, 0, None][k % 5], "sold_at": "2001-02-02" if k % 11 == 0 else None} for k in range(60)]
    for shop in (make_shop(items=items), make_shop(items=items[:1]), make_shop()):
        board = dashboard.Dashboard(shop, AS_OF)
        for name, report in dashboard.REPORTS.items():
            assert same(report(board), SINGLE[name](shop)), name


def test_the_items_are_read_once(stored_shop):
    folder, t = stored_shop
    text = plan(dashboard.stock_sums(t, AS_OF))
    (scan,) = [line for line in text.splitlines() if "FileScan" in line]
    assert "EqualTo(active,1)" in scan and "notes" not in scan and "Expand" in text
    board = dashboard.Dashboard(t, AS_OF)
    assert all(f"{folder}/items" not in plan(report(board)) for report in dashboard.REPORTS.values())


def brute_classes(rows):
    """By whole cents, one row after the other."""
    ordered = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    whole, reached, out = sum(round((r or 0) * 10000) for _, r in rows), 0, {}
    for key, revenue in ordered:
        reached += round((revenue or 0) * 10000)
        out[key] = "C" if not whole else "A" if reached * 100 <= 80 * whole else "B" if reached * 100 <= 95 * whole else "C"
    return out


def test_abc_of_many_rows(spark):
    rows = [(f"K{k:04}", [0.0, 5.25, 5.25, 17.5, 1000.0][k * k % 5] + k // 700) for k in range(2000)]
    limits = [("a", 80.0), ("b", 15.0), ("c", 5.0)]  # each ends exactly on a limit
    for some in (rows, limits, [("a", 0.0), ("b", 0.0)], [("a", None), ("b", 2.0)], []):
        df = spark.createDataFrame(some, "sku string, revenue double").repartition(7)
        got = abc.abc_classes_of_many(df, "sku")
        assert {r["sku"]: r["abc_class"] for r in got.collect()} == brute_classes(some)
        assert "SinglePartition" not in plan(got)


def test_abc_by_category_agrees_with_the_window_over_all(spark, stored_shop):
    revenue = abc.category_revenue(stored_shop[1], dt.date(2001, 1, 1), AS_OF)
    few = {r["category"]: r["revenue"] for r in abc.abc_classes(revenue).collect()}
    many = {r["category"]: r["revenue"] for r in abc.abc_classes_of_many(revenue, "category").collect()}
    assert few == many and len(few) > 3
