"""Hand-made rows for the listings, key figures and analyses."""

import datetime as dt

import pytest
from conftest import rows

from rackwise.operators import abc, consignors, inventory, kpis, listings, photos
from rackwise.operators import sales_reports as reports

AS_OF = dt.date(2025, 8, 31)
START, END = dt.date(2025, 8, 1), dt.date(2025, 8, 31)


def ago(days):
    return AS_OF - dt.timedelta(days=days)


@pytest.fixture
def shop(make_shop):
    """Fan-out, orphans and gaps: item "a" sold twice, sales of a deleted item and consignor, NULL values."""
    return make_shop(
        consignors=[
            {"id": "C0001", "name": "Ana", "pix_key": "ana@x", "percent": 0.4, "whatsapp": ""},
            {"id": "C0002", "name": "Bia", "percent": None, "active": 0},
            {"id": "C0003", "name": "Caio", "active": None},
        ],
        items=[
            {"sku": "a", "consignor_id": "C0001", "category": "Vestido", "brand": "Zara", "size": "M", "list_price": 100.0,
             "listed_at": "2025-08-05", "sold_at": "2025-08-20"},
            {"sku": "b", "consignor_id": "C0001", "category": "Vestido", "brand": None, "size": "M", "list_price": 50.0,
             "markdown_stage": 1, "listed_at": "2025-08-10", "photos_url": ""},
            {"sku": "c", "consignor_id": "C0002", "category": "Bolsa", "brand": "50%_off", "size": None, "list_price": 20.0,
             "markdown_stage": 3, "listed_at": "2025-01-01", "photos_url": "photos/c"},
            {"sku": "d", "consignor_id": None, "category": None, "brand": "zARA", "size": "G", "list_price": 30.0,
             "markdown_stage": None, "listed_at": None},
            {"sku": "e", "consignor_id": "C0009", "category": "Bolsa", "size": "G", "list_price": 10.0, "listed_at": "2025-08-30",
             "active": 0},
        ],
        sales=[
            {"id": "V2508001", "date": "2025-08-10", "sku": "a", "sale_price": 90.0, "discount_value": 10.0, "consignor_id": "C0001"},
            {"id": "V2508002", "date": "2025-08-20", "sku": "a", "sale_price": 90.0, "discount_value": None, "consignor_id": "C0001"},
            {"id": "V2508003", "date": "2025-08-31", "sku": "gone", "sale_price": 40.0, "consignor_id": "C0002"},
            {"id": "V2508004", "date": "2025-08-01", "sku": "d", "sale_price": 25.0, "consignor_id": None},
            {"id": "V2508005", "date": "2025-08-15", "sku": "e", "sale_price": 8.0, "discount_value": 9.0, "consignor_id": "C0009"},
            {"id": "V2507001", "date": "2025-07-31", "sku": "b", "sale_price": 11.0, "consignor_id": "C0001"},
        ],
    )


def test_kpis(shop):
    # Sales count the deleted item's too; days only where both dates are known: 5, 15 and -15.
    assert rows(kpis.kpis(shop, START, END)) == [(3, 5, 234.0, 5 / 3 * 100, 5 / 3)]


def test_kpis_of_an_empty_period(shop):
    assert rows(kpis.kpis(shop, dt.date(2020, 1, 1), dt.date(2020, 1, 31))) == [(3, 0, 0.0, 0.0, 0.0)]
    texts = dict(rows(kpis.kpi_cards(shop, dt.date(2020, 1, 1), dt.date(2020, 1, 31))))
    assert texts == {"Estoque Atual": "3", "Vendas (Período)": "0", "Receita (Período)": "R$ 0.00", "Taxa de Venda": "0.0%",
                     "Dias p/ Vender": "0.0"}


def test_kpis_of_an_empty_shop(make_shop):
    assert rows(kpis.kpis(make_shop(), START, END)) == [(0, 0, 0.0, 0.0, 0.0)]


def test_revenue_by_category_drops_orphans_and_keeps_null_category(shop):
    assert rows(reports.revenue_by_category(shop, START, END)) == [("Vestido", 2, 170.0), (None, 1, 25.0), ("Bolsa", 1, -1.0)]


def test_sales_history_keeps_orphans_and_null_net(shop):
    history = {r["id"]: (r["category"], r["liquido"]) for r in listings.sales_history(shop).collect()}
    assert history["V2508003"] == (None, 40.0) and history["V2508002"] == ("Vestido", None) and history["V2508005"] == ("Bolsa", -1.0)
    assert [r["id"] for r in listings.sales_history(shop).collect()][:2] == ["V2508003", "V2508002"]


def test_payouts(shop):
    assert rows(reports.payouts(shop, START, END)) == [
        ("C0001", "Ana", "ana@x", 0.4, 170.0, 2, 68.0, 102.0),
        ("C0002", "Bia", None, 0.5, 40.0, 1, 20.0, 20.0),  # no share recorded: one half
        ("C0009", None, None, 0.5, -1.0, 1, -0.5, -0.5),   # deleted consignor
    ]
    headings = reports.payout_report(shop, START, END).columns
    assert headings == ["ConsignanteID", "Nome", "Peças", "Vendas líquidas (R$)", "% Consignante", "Valor p/ Consignante (R$)",
                        "Valor p/ Loja (R$)", "Chave Pix"]


def test_top_consignors_need_an_existing_consignor(shop):
    assert rows(reports.top_consignors(shop, START, END)) == [("Ana", 2, 170.0, 85.0), ("Bia", 1, 40.0, 40.0)]


def test_sell_through_counts_joined_rows(shop):
    assert rows(inventory.sell_through_matrix(shop, START, END)) == [("Vestido", "M", 2, 3, 66.7)]
    assert rows(inventory.sell_through_matrix(shop, START, END, distinct_items=True)) == [("Vestido", "M", 1, 2, 50.0)]
    every = inventory.sell_through_matrix(shop, START, END, min_total=1)
    assert rows(every) == [("Bolsa", "G", 1, 1, 100.0), ("Vestido", "M", 2, 3, 66.7)]


def test_pivot(shop):
    fixed = inventory.sell_through_pivot(shop, START, END, ["G", "M", "XL"], min_total=1)
    assert fixed.columns == ["category", "G", "M", "XL"]
    assert rows(fixed) == [("Bolsa", 100.0, 0.0, 0.0), ("Vestido", 0.0, 66.7, 0.0)]
    assert inventory.sell_through_pivot(shop, START, END, min_total=1).columns == ["category", "G", "M"]


def test_stage_reports(shop):
    assert rows(inventory.stock_by_stage(shop)) == [
        (None, "Outro", 1, 30.0), (1, "1º desconto (-10%)", 1, 45.0), (3, "3º desconto (-40%)", 1, 12.0)]
    assert rows(reports.performance_by_stage(shop, START, END)) == [(None, "Outro", 1, None), (0, "Preço cheio", 3, 5 / 3)]


def test_fast_movers_include_sales_before_listing(shop):
    got = rows(listings.fast_movers(shop, START, END))
    assert got == [("e", "Bolsa", None, "G", -15, -1.0), ("a", "Vestido", "Zara", "M", 5, 80.0)]


def test_consignor_performance_fans_out_and_ranks_nulls_last(make_shop):
    t = make_shop(
        consignors=[{"id": f"C{n}", "name": f"n{n}"} for n in (1, 2, 3, 4)] + [{"id": "C5", "name": "off", "active": 0}],
        items=[
            {"sku": "a", "consignor_id": "C1", "listed_at": ago(10)}, {"sku": "b", "consignor_id": "C2", "listed_at": ago(200)},
            {"sku": "c", "consignor_id": "C3", "listed_at": ago(30)}, {"sku": "d", "consignor_id": "C4", "listed_at": ago(31)},
            {"sku": "e", "consignor_id": "C5", "listed_at": ago(1)},
        ],
        sales=[
            {"id": "1", "date": ago(5), "sku": "a", "sale_price": 10.0, "consignor_id": "C9"},
            {"id": "2", "date": ago(40), "sku": "a", "sale_price": 10.0},
            {"id": "3", "date": ago(2), "sku": "b", "sale_price": 7.0, "discount_value": 2.0},
        ],
    )
    got = rows(consignors.consignor_performance(t, AS_OF))
    assert got == [
        ("n1", 2, 1, 50.0, 10.0),   # the item counts once per sale, old sales too
        ("n3", 1, 0, 0.0, 0.0),
        ("n2", 0, 1, 0.0, 5.0),     # nothing added: no rate, so last
    ]
    assert rows(consignors.consignor_performance(t, AS_OF, distinct_items=True))[0] == ("n1", 1, 1, 100.0, 10.0)
    assert rows(consignors.top_performers(t, AS_OF)) == got[:1]
    assert rows(consignors.low_performers(t, AS_OF, min_added=1)) == got[1:2]
    assert rows(consignors.low_performers(t, AS_OF)) == []


def shop_with_revenues(make_shop, revenues):
    return make_shop(
        items=[{"sku": c, "category": c, "listed_at": "2025-01-01"} for c in revenues],
        sales=[{"id": c, "date": "2025-08-10", "sku": c, "sale_price": v} for c, v in revenues.items()])


@pytest.mark.parametrize(("revenues", "classes"), [
    ({"x": 80.0, "y": 15.0, "z": 5.0}, "ABC"),       # exactly 80 and 95
    ({"x": 80.1, "y": 14.9, "z": 5.0}, "BBC"),
    ({"x": 100.0}, "C"),                              # its own share counts: 100 > 95
    ({c: 10.0 for c in "abcdefghij"}, "AAAAAAAABC"),  # ten tenths, running sum without drift
])
def test_abc_boundaries(make_shop, revenues, classes):
    got = rows(abc.abc_analysis(shop_with_revenues(make_shop, revenues), START, END))
    assert "".join(r[5] for r in got) == classes
    assert abs(sum(r[3] for r in got) - 100) <= 0.05 * len(got) + 1e-9


def test_abc_summary_and_no_revenue(make_shop):
    t = shop_with_revenues(make_shop, {"x": 80.0, "y": 15.0, "z": 5.0})
    assert rows(abc.abc_summary(t, START, END)) == [("A", 1, 80.0, 80.0), ("B", 1, 15.0, 15.0), ("C", 1, 5.0, 5.0)]
    assert rows(abc.abc_analysis(make_shop(), START, END)) == []
    assert rows(abc.abc_analysis(shop_with_revenues(make_shop, {"x": 0.0}), START, END)) == [("x", 1, 0.0, None, None, "C")]


def test_ageing_and_slow_items(make_shop):
    t = make_shop(items=[{"sku": f"{c}{n}", "category": c, "size": "M", "list_price": 1.0, "markdown_stage": n % 4, "listed_at": ago(n)}
                         for c in ("x", "y") for n in range(55, 62 if c == "x" else 60)] + [{"sku": "old", "category": "x", "listed_at": ago(91)},
                                                                              {"sku": "edge", "category": "x", "listed_at": ago(90)}])
    assert rows(inventory.category_ageing(t, AS_OF)) == [("x", 9, 3, 33.3)]   # y has only five items
    assert rows(inventory.problem_categories(t, AS_OF)) == []
    assert [(r["sku"], r["days_listed"], r["discount"]) for r in listings.very_slow_items(t, AS_OF).collect()] == [("old", 91, "0%")]
    assert rows(inventory.slow_movers(t, AS_OF)) == [("x", 3)]
    assert rows(kpis.old_items(t, AS_OF)) == [(1,)]
    assert rows(inventory.stock_gaps(t)) == [("x", None, 2)]


def test_demand(make_shop):
    items = [{"sku": f"s{n}", "category": "x", "size": "M", "listed_at": ago(20), "sold_at": ago(6)} for n in range(3)]
    items += [{"sku": f"u{n}", "category": "y", "size": "G", "listed_at": ago(90), "active": 0} for n in range(3)]
    items += [{"sku": f"w{n}", "category": "z", "size": "P", "listed_at": ago(80), "sold_at": ago(30) if n else None} for n in range(4)]
    t = make_shop(items=items, sales=[{"id": f"{n}", "date": ago(6), "sku": f"s{n}", "sale_price": 1.0} for n in range(3)])
    assert rows(reports.high_demand(t, AS_OF)) == [("x", "M", 3, 14.0)]
    # Never sold, or sold slowly; inactive items count as well.
    assert rows(inventory.low_demand(t, AS_OF)) == [("z", "P", 4, 3, 50.0), ("y", "G", 3, 0, 0.0)]


def test_action_summary(make_shop):
    assert [r["action"] for r in kpis.action_summary(make_shop(), AS_OF).collect()] == [
        "✅ Nenhuma ação urgente identificada. Estoque bem gerido!"]
    many = [{"sku": str(n), "category": "x", "markdown_stage": 3, "listed_at": ago(91)} for n in range(21)]
    assert [r["action"] for r in kpis.action_summary(make_shop(items=many), AS_OF).collect()] == [
        "📦 Considerar bundle/doação de 21 itens antigos (>90 dias)", "⚠️ 1 categorias com estoque alto (>20 itens)"]
    ten = [{"sku": str(n), "category": None, "markdown_stage": 2, "listed_at": ago(91)} for n in range(10)]
    assert [r["action"] for r in kpis.action_summary(make_shop(items=ten), AS_OF).collect()] == ["🏷️ Atualizar desconto de 10 itens"]
    uncategorised = [{"sku": str(n), "category": None, "markdown_stage": 3, "listed_at": ago(9)} for n in range(25)]
    t = make_shop(items=uncategorised)
    assert rows(kpis.overstocked_categories(t)) == [(0,)]
    assert rows(kpis.markdown_pending(t, AS_OF)) == [(0,)]


def test_consignor_lists(shop, make_shop):
    assert rows(listings.consignor_cards(shop)) == [
        ("C0001", "Ana", "—", "40%", "✅ Ativo"), ("C0002", "Bia", "—", None, "❌ Inativo"), ("C0003", "Caio", "—", "50%", "❌ Inativo")]
    assert rows(listings.active_consignors(shop)) == [("C0001", "Ana")]
    assert rows(listings.consignor_list(shop))[0] == ("C0001", "Ana", "", None, "ana@x", 0.4, 1)
    named = {r["sku"]: r["consignor_name"] for r in listings.with_consignor_name(shop.items, shop.consignors).collect()}
    assert named == {"a": "Ana", "b": "Ana", "c": "", "d": "", "e": ""}
    t = make_shop(consignors=[{"id": f"C{n}", "name": n_} for n, n_ in enumerate(["José", "joséfa", "50%_x", "Zé", "JOSÉ", "a", "b"])])
    assert [r["name"] for r in listings.search_consignors(t, "SÉ").collect()] == ["JOSÉ", "José", "joséfa"]
    assert [r["name"] for r in listings.search_consignors(t, "%_").collect()] == ["50%_x"]
    assert rows(listings.search_consignors(t, "")) == []
    assert listings.search_consignors(t, "a", limit=1).count() == 1


def test_gallery_filters_and_texts(shop):
    def found(**filters):
        return [r["sku"] for r in listings.gallery(shop, **filters).collect()]

    assert found() == ["b", "c", "d"]
    assert found(brand="zara") == ["d"]
    assert found(brand="0%_o") == ["c"]      # wildcards of LIKE stay wildcards
    assert found(category="Bolsa") == ["c"] and found(with_photos=True) == ["c"] and found(category="Saia") == []
    cards = {r["sku"]: (r["title"], r["current_price"], r["price_text"], r["struck_price_text"], r["percent_off_text"])
             for r in listings.gallery(shop).collect()}
    assert cards == {"b": ("Vestido  M", 45.0, "R$ 45.00", "R$ 50.00", "10% OFF"),
                     "c": ("Bolsa 50%_off", 12.0, "R$ 12.00", "R$ 20.00", "40% OFF"), "d": ("zARA G", 30.0, "R$ 30.00", None, None)}


def test_pickers_and_lookups(shop, spark):
    got = [(r["picker_text"], r["picked_sku"]) for r in listings.recent_stock(shop, n=2).collect()]
    assert got == [("b - Vestido  M", "b"), ("c - Bolsa 50%_off", "c")]
    keys = spark.createDataFrame([("a",), ("a",), ("zz",), (None,)], "sku string")
    assert [r["sku"] for r in listings.item_by_sku(shop, keys).collect()] == ["a"]
    assert [r["sku"] for r in listings.stock_list(shop).collect()] == ["e", "b", "a", "c", "d"]
    with pytest.raises(ValueError):
        listings.label_batch(shop, AS_OF, n=51)
    assert [r["sku"] for r in listings.label_batch(shop, AS_OF, max_age=30).collect()] == ["b"]
    assert [r["sku"] for r in listings.markdown_label_items(shop, 3).collect()] == ["c"]


def test_photo_reports(shop, make_shop):
    assert rows(photos.photo_stats(shop)) == [(3, 1, 2, 33.3, 66.7)]
    assert rows(photos.photo_stats(make_shop())) == [(0, 0, 0, None, None)]
    assert rows(photos.photo_coverage(shop)) == [(None, 1, 0, 0.0), ("Vestido", 1, 0, 0.0), ("Bolsa", 1, 1, 100.0)]
    assert rows(photos.low_photo_coverage(shop, min_total=1)) == [(None, 1, 0, 0.0), ("Vestido", 1, 0, 0.0)]
    work = {p: [r["sku"] for r in photos.photo_worklist(shop, p, AS_OF).collect()] for p in ("all", "new", "high_value", "categories")}
    assert work == {"all": ["b", "d"], "new": ["b"], "high_value": ["b"], "categories": ["b"]}
    assert photos.photo_list_report(photos.photo_worklist(shop)).columns == ["SKU", "Categoria", "Marca", "Tamanho", "Preço"]


def test_photo_inventory_from_paths(spark, shop):
    names = ["a/a_2.jpg", "a/a_1.png", "a/a_1.jpg", "a/x.JPG", "b/b_1.png", "b/b_1.jpeg", "zz/q.png", "e/e.gif", "solto.jpg", "c/velhas/c_1.jpg"]
    inventory_ = photos.photo_inventory(spark.createDataFrame([(f"file:/x/photos/{n}",) for n in names], "path string"))
    got = {r["sku"]: (r["n_files"], r["first_file"]) for r in inventory_.collect()}
    assert got == {"a": (3, "a_1.jpg"), "b": (2, "b_1.jpeg"), "zz": (1, "q.png")}
    stamped = {r["sku"]: r["photos_url"] for r in photos.stamp_photos(shop.items, inventory_).collect()}
    assert stamped == {"a": "photos/a", "b": "photos/b", "c": "photos/c", "d": None, "e": None}
    assert rows(photos.orphan_photo_folders(shop, inventory_)) == [("zz",)]
    gone = photos.photo_inventory(spark.createDataFrame([(f"photos/{n}/1.jpg",) for n in ("y", "a", "x")], "path string"))
    assert rows(photos.orphan_photo_summary(shop, gone, shown=1)) == [(2, "x", 1)]
    assert rows(photos.orphan_photo_summary(shop, gone.filter("sku = 'a'"))) == [(0, "", 0)]
