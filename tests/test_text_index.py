"""Substring search by trigrams gives what the scan gives."""

import pytest

from rackwise.operators import listings, text_index

NAMES = ["Ana Lima", "ANA", "an", "a", "", None, "Mariana Ávila", "ana lima", "Banana & Cia", "João d'Ávila", "%_%", "a_b%c", "zzz", "Ana  Lima", "ÁVILA", "İstanbul", "aaaaaaa"]
NEEDLES = ["a", "an", "ana", "ANA", "ana l", "lima", "ávila", "d'á", "%_", "_b%", "zz", "zzzz", "", "  ", "banana & ci", "mariana ávil", "istanb", "aaaa", "nope"]


@pytest.fixture
def shop(make_shop):
    people = [{"id": f"C{k}", "name": n, "active": int(k % 5 != 2)} for k, n in enumerate(NAMES * 2)]
    items = [{"sku": f"S{k}", "brand": n, "category": "AB"[k % 2], "listed_at": "2025-01-01", "photos_url": "p" if k % 3 else ""} for k, n in enumerate(NAMES * 2)]
    return make_shop(consignors=people, items=items)


def test_consignors(spark, shop, tmp_path):
    text_index.create_text_index(shop.consignors, "name", str(tmp_path / "names"))
    for needle in NEEDLES:
        for limit in (3, 100):
            want = listings.search_consignors(shop, needle, limit).collect()
            assert text_index.search_consignors(shop, str(tmp_path / "names"), needle, limit).collect() == want, needle


def test_brands_with_wildcards(spark, shop, tmp_path):
    text_index.create_text_index(shop.items, "brand", str(tmp_path / "brands"))
    for pattern in [n for n in NEEDLES if n] + ["an%lim", "a__", "%ana%", "l_ma", "m%r%a%", "á_il"]:
        want = listings.gallery(shop, brand=pattern, with_photos=True).collect()
        assert text_index.gallery_by_brand(shop, str(tmp_path / "brands"), pattern, with_photos=True).collect() == want, pattern


def test_a_search_opens_its_trigrams_folders(spark, shop, tmp_path):
    text_index.create_text_index(shop.consignors, "name", str(tmp_path / "names"))
    plan = text_index.texts_containing(spark, str(tmp_path / "names"), "mari")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "/texts" not in plan and "In(trigram" in plan
    short = text_index.texts_containing(spark, str(tmp_path / "names"), "ma")._jdf.queryExecution().executedPlan().toString()
    assert "/texts" in short and "trigram" not in short


def test_an_index_of_nothing(spark, make_shop, tmp_path):
    text_index.create_text_index(make_shop().consignors, "name", str(tmp_path / "none"))
    assert text_index.texts_containing(spark, str(tmp_path / "none"), "ana").collect() == []
    assert text_index.texts_like(spark, str(tmp_path / "none"), "a").collect() == []
