"""Reading, writing and listing."""

import datetime as dt

import pytest
from conftest import rows

from rackwise.operators import photos
from rackwise.operators.listings import sales_history
from rackwise.sources.photos import list_photo_files
from rackwise.sources.schema import ITEMS, SCHEMAS
from rackwise.sources.tables import load_tables, run_sql, write_csv, write_tables
from rackwise.sources.workspace import new_folder, shared_folder


@pytest.fixture
def shop(make_shop):
    return make_shop(
        consignors=[{"id": "C0001", "name": 'Ana "Nina", a primeira', "notes": "duas\nlinhas", "email": ""}],
        items=[{"sku": "a", "category": "Calça", "listed_at": "2025-08-05", "photos_url": ""}, {"sku": "b", "listed_at": None}],
        sales=[{"id": "V2508001", "date": "2025-08-10", "sku": "a", "sale_price": 90.0}],
    )


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_tables_come_back_as_written(spark, shop, tmp_path, fmt):
    folder = str(tmp_path / fmt)
    write_tables(shop, folder, fmt)
    back = load_tables(spark, folder, fmt)
    for name, df in shop.named().items():
        assert [f.dataType for f in back.named()[name].schema] == [f.dataType for f in SCHEMAS[name]]
        assert sorted(rows(back.named()[name]), key=str) == sorted(rows(df), key=str)


def test_malformed_dates_become_null(spark, tmp_path):
    folder = tmp_path / "items"
    folder.mkdir()
    header = ",".join(f.name for f in ITEMS)
    cells = {"ok": "2025-08-05", "word": "ontem", "order": "05/08/2025", "day": "2025-02-30", "gap": ""}
    lines = [header] + [",".join(sku if f.name == "sku" else text if f.name == "listed_at" else "" for f in ITEMS) for sku, text in cells.items()]
    (folder / "items.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    for other in ("consignors", "sales"):
        (tmp_path / other).mkdir()
        (tmp_path / other / "x.csv").write_text(",".join(f.name for f in SCHEMAS[other]) + "\n", encoding="utf-8")
    t = load_tables(spark, str(tmp_path), "csv")
    got = {r["sku"]: r["listed_at"] for r in t.items.collect()}
    assert got == {"ok": dt.date(2025, 8, 5), "word": None, "order": None, "day": None, "gap": None}
    assert t.sales.count() == 0


def test_unknown_format(spark):
    with pytest.raises(ValueError):
        load_tables(spark, "/nowhere", "xml")


def test_csv_export_has_a_header_and_no_index(spark, tmp_path):
    df = spark.createDataFrame([("Bia", "Peça"), ("Zé", None)], "`Nome` string, `Valor (R$)` string").coalesce(1)
    write_csv(df, str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    assert part.read_text(encoding="utf-8") == "Nome,Valor (R$)\nBia,Peça\nZé,\n"


def test_sql_with_parameters(spark, shop):
    by_name = run_sql(spark, shop, "SELECT sku FROM items WHERE category = :c", {"c": "Calça"})
    by_place = run_sql(spark, shop, "SELECT s.id FROM sales s JOIN items i ON s.sku = i.sku WHERE s.date >= ? AND i.sku = ?",
                       [dt.date(2025, 8, 1), "a"])
    assert rows(by_name) == [("a",)] and rows(by_place) == [("V2508001",)]
    # A parameter is a value, never a piece of SQL.
    assert rows(run_sql(spark, shop, "SELECT sku FROM items WHERE sku = ?", ["a' OR '1' = '1"])) == []


def test_photo_files_on_disk(spark, tmp_path, shop):
    root = tmp_path / "photos"
    for name in ("a/a_1.jpg", "a/a_2.png", "a/nota.txt", "a/A_3.JPG", "zz/z.jpeg"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"x")
    files = list_photo_files(spark, str(root))
    assert files.columns == ["path"] and files.count() == 3
    found = photos.photo_inventory(files, root=str(root))
    assert sorted(rows(found)) == [("a", 2, "a_1.jpg"), ("zz", 1, "z.jpeg")]
    assert rows(photos.orphan_photo_folders(shop, found)) == [("zz",)]


def test_folder_named_by_the_session_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_orphan_sales_survive_a_round_trip(spark, shop, tmp_path):
    write_tables(shop, str(tmp_path / "t"))
    assert sales_history(load_tables(spark, str(tmp_path / "t"))).count() == 1
