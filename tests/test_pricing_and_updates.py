"""Hand-made rows for prices, markdowns, dates, payouts and labels."""

import datetime as dt

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rackwise.functions import columns as col
from rackwise.functions.dates import age_in_days, at_most_old, default_period, older_than
from rackwise.operators import labels, markdown, quality
from rackwise.operators.sales_reports import payout_split

AS_OF = dt.date(2025, 8, 31)


def ago(days):
    return AS_OF - dt.timedelta(days=days)


def test_markdown_price_by_stage(make_table):
    items = make_table("items", [
        {"sku": str(i), "list_price": price, "markdown_stage": stage}
        for i, (price, stage) in enumerate([(100.0, 0), (100.0, 1), (100.0, 2), (100.0, 3), (100.0, 4), (100.0, -1), (100.0, None),
                                            (0.35, 1), (10.01, 2), (None, 1)])
    ])
    got = rows(items.orderBy(F.col("sku").cast("int")).select(
        col.markdown_price(), col.markdown_price(rounded_to_cents=False), col.percent_off()))
    assert got == [
        (100.0, 100.0, None), (90.0, 90.0, 10), (75.0, 75.0, 25), (60.0, 60.0, 40),
        (100.0, 100.0, None), (100.0, 100.0, None), (100.0, 100.0, None),
        (0.32, 0.315, 10),  # half a cent goes up
        (7.51, 7.5075, 25), (None, None, 10),
    ]


def test_stage_names(make_table):
    items = make_table("items", [{"sku": str(i), "markdown_stage": s} for i, s in enumerate([0, 1, 2, 3, 4, None])])
    got = rows(items.orderBy("sku").select(*[col.stage_name(style=s) for s in ("long", "short", "percent")]))
    assert got == [
        ("Preço cheio (0%)", "Preço cheio", "0%"), ("1º desconto (-10%)", "1º desconto", "10%"),
        ("2º desconto (-25%)", "2º desconto", "25%"), ("3º desconto (-40%)", "3º desconto", "40%"),
        ("Outro", "Outro", None), ("Outro", "Outro", None),
    ]


def test_age_limits_by_date_and_by_time_of_day(spark, make_table):
    items = make_table("items", [{"sku": str(n), "listed_at": ago(n)} for n in (29, 30, 31)] + [{"sku": "none"}])
    midnight, noon = AS_OF, dt.datetime.combine(AS_OF, dt.time(12))
    got = {r[0]: r[1:] for r in rows(items.select(
        "sku", older_than("listed_at", midnight, 30), older_than("listed_at", noon, 30),
        at_most_old("listed_at", midnight, 30), at_most_old("listed_at", noon, 30), age_in_days("listed_at", noon)))}
    assert got == {
        "29": (False, False, True, True, 29.5),
        "30": (False, True, True, False, 30.5),  # half a day past day 30 is more than 30
        "31": (True, True, False, False, 31.5),
        "none": (None, None, None, None, None),
    }
    # The comparison with one literal day says the same as the age itself.
    for as_of in (midnight, noon):
        wrong = items.filter(F.col("listed_at").isNotNull()).filter(older_than("listed_at", as_of, 30) != (age_in_days("listed_at", as_of) > 30))
        assert wrong.count() == 0


def test_default_period():
    assert default_period(dt.datetime(2025, 8, 31, 9)) == (dt.date(2025, 8, 1), dt.date(2025, 8, 31))


def cascade_items(make_table):
    bounds = [30, 31, 60, 61, 90, 91]
    items = [{"sku": f"{age}-{stage}", "listed_at": ago(age), "markdown_stage": stage}
             for age in bounds for stage in (0, 1, 2, 3, None, 4, -1)]
    items += [
        {"sku": "sold", "listed_at": ago(100), "sold_at": ago(1)},
        {"sku": "inactive", "listed_at": ago(100), "active": 0},
        {"sku": "flagless", "listed_at": ago(100), "active": None},
        {"sku": "undated"},
    ]
    return make_table("items", items)


def test_cascade(make_table):
    moved = {r["sku"]: r["markdown_stage"] for r in markdown.apply_markdowns(cascade_items(make_table), AS_OF).collect()}
    reach = {30: 0, 31: 1, 60: 1, 61: 2, 90: 2, 91: 3}
    for age, limit in reach.items():
        for stage in (0, 1, 2, 3):
            assert moved[f"{age}-{stage}"] == max(stage, limit), (age, stage)
        assert [moved[f"{age}-{s}"] for s in (None, 4, -1)] == [None, 4, -1]
    assert [moved[s] for s in ("sold", "inactive", "flagless", "undated")] == [0, 0, 0, 0]


def test_cascade_is_idempotent_and_matches_the_pending_list(make_shop, make_table):
    items = cascade_items(make_table)
    once = markdown.apply_markdowns(items, AS_OF)
    assert sorted(rows(markdown.apply_markdowns(once, AS_OF)), key=str) == sorted(rows(once), key=str)
    assert rows(markdown.markdown_transitions(once, AS_OF)) == [(0, 0, 0, 0)]
    t = make_shop()
    pending = dict(rows(markdown.pending_markdowns(type(t)(t.consignors, items, t.sales), AS_OF)))
    # Stage -1 is "below" every target in the list, but the cascade does not move it.
    assert pending == {"Para 10% OFF": 4, "Para 25% OFF": 6, "Para 40% OFF": 4}
    assert rows(markdown.pending_total(type(t)(t.consignors, items, t.sales), AS_OF)) == [(14,)]


def test_each_step_counts_as_a_transition(make_table):
    items = make_table("items", [{"sku": "a", "listed_at": ago(100)}, {"sku": "b", "listed_at": ago(100), "markdown_stage": 2}])
    assert rows(markdown.markdown_transitions(items, AS_OF)) == [(1, 1, 2, 4)]


def test_payout_split_of_texts_and_gaps(spark):
    df = spark.createDataFrame(
        [("100", "0.4"), ("abc", "0.5"), (None, "0.5"), ("10.01", "0.5"), ("-20", "0.5"), ("10", None), ("1e2", "0.25")],
        "total_net string, percent string")
    assert [r[2:] for r in rows(payout_split(df))] == [
        (40.0, 60.0), (0.0, 0.0), (0.0, 0.0), (5.01, 5.0), (-10.0, -10.0), (0.0, 10.0), (25.0, 75.0)]
    assert rows(payout_split(spark.createDataFrame([(10.0,)], "total_net double"))) == [(10.0, 5.0, 5.0)]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-10**9, 10**9), st.integers(0, 100)), min_size=1, max_size=40))
def test_payout_parts_add_up(spark, pairs):
    df = spark.createDataFrame([(c / 100, p / 100) for c, p in pairs], "total_net double, percent double")
    for (cents, _), row in zip(pairs, payout_split(df).collect(), strict=True):
        assert round(row["consignor_value"] * 100) + round(row["shop_value"] * 100) == cents


def test_label_texts(make_table):
    items = make_table("items", [
        {"sku": "1", "category": "Vestido", "brand": "Zara", "size": "42", "condition": "A", "list_price": 50.0},          # 15 characters
        {"sku": "2", "category": "Vestido", "brand": "Zarah", "size": "42", "condition": "B", "list_price": 50.0, "markdown_stage": 1},  # 16
        {"sku": "3", "category": "Acessório", "brand": "Compridíssima", "condition": "C", "list_price": 0.35, "markdown_stage": 4},
        {"sku": "4", "category": "Bolsa", "brand": "", "size": "M", "condition": "A-", "list_price": 9.0, "markdown_stage": None},
    ])
    got = {r[0]: r[1:] for r in rows(labels.label_manifest(items))}
    assert got == {
        "1": ("Vestido Zara 42", "Vestido Zara 42", None, "Estado: A", "R$ 50.00", None),
        "2": ("Vestido Zarah 42", "Vestido Zarah", "42", "Estado: B", "R$ 45.00", "(R$ 50.00)"),
        "3": ("Acessório Compridíssima", "Acessório Compridíssima", None, "Estado: C", "R$ 0.35", "(R$ 0.35)"),
        "4": ("Bolsa M", "Bolsa M", None, "Estado: A-", "R$ 9.00", None),
    }
    large = {r[0]: r[2:4] for r in rows(labels.label_manifest(items, small=False))}
    assert large["2"] == ("Vestido Zarah 42", None)


def test_nine_labels_on_sheets_of_eight(make_table):
    items = make_table("items", [{"sku": f"{n:02d}"} for n in range(9)])
    placed = {r["sku"]: (r["slot"], r["sheet"], r["col"], r["row"]) for r in labels.label_sheet(items).collect()}
    assert placed["00"] == (0, 0, 0, 0) and placed["01"] == (1, 0, 1, 0)
    assert placed["07"] == (7, 0, 1, 3) and placed["08"] == (8, 1, 0, 0)
    one_sheet = {r["sku"] for r in labels.label_sheet(items, first_sheet_only=True).collect()}
    assert one_sheet == {f"{n:02d}" for n in range(8)}


def test_value_checks_report_and_keep_rows(make_table):
    items = make_table("items", [{"sku": "1", "category": "Bolsa", "condition": "A-", "gender": "F"}, {"sku": "2", "category": "bolsa"}])
    checked = {r["sku"]: (r["category_known"], r["condition_known"], r["gender_known"], r["fit_known"]) for r in quality.check_items(items).collect()}
    assert checked == {"1": (True, True, True, False), "2": (False, False, False, False)}
    sales = make_table("sales", [{"id": "1", "date": AS_OF, "sku": "1", "sale_price": 1.0, "channel": "Loja", "payment_method": "Cheque"}])
    assert rows(quality.check_sales(sales).select("channel_known", "payment_method_known")) == [(True, False)]
