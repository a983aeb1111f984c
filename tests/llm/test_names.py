"""Every operator keeps further columns, whatever their names, and replaces those named as its own."""

import numpy as np
import pytest

from rackwise.llm.catalogue import URL_RULES, language_training
from rackwise.llm.common import any_names, fixed_rows
from rackwise.llm.decontamination import find_contamination
from rackwise.llm.embedding_join import link_vectors, usable
from rackwise.llm.html_text import extract_text
from rackwise.llm.language import fit_languages, identify_language
from rackwise.llm.mixing import mix
from rackwise.llm.near_duplicates import keep_one, mark_near_duplicates
from rackwise.llm.pii import replace_personal_data
from rackwise.llm.quality_model import with_statistics
from rackwise.llm.recompression import remove_repeats
from rackwise.llm.secrets import scan_secrets
from rackwise.llm.url_filters import judge_urls

ODD = {name: f"{name}!" for name in (
    "a.b", "_meta", "_text", "_key", "_node", "_host", "_page", "_url", "_vector", "_body", "_again", "_size", "_group", "_spans", "_template",
    "_keepers", "_links", "_least", "_of", "_draw", "_new", "_scaled", "name", "found", "kinds_", "keeper", "number", "n_docs", "c0", "r1", "Label_", "with space", "q`s",
)}
ODD.pop("q`s")  # Spark itself can't name such a column in a schema text
TEXTS = ["the house is by the river and the road", "password = abcdefgh12345 of Mr. Paul Brown", None, "", "the house is by the river and the road"]
HTML = "<body><nav>menu</nav><article><p>one two</p></article></body>"


def table(spark, more):
    """Five rows of the columns in ``more`` and all odd ones."""
    names = [*more, *ODD]
    rows = [(*[values[k] for values, _ in more.values()], *ODD.values()) for k in range(5)]
    kinds = [kind for _, kind in more.values()] + ["string"] * len(ODD)
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds, strict=True)))


def docs(spark, **clashes):
    more = {"doc_id": (range(5), "long"), "text": (TEXTS, "string"), "lang": (["en"] * 5, "string"), "source": (["web", "web", None, "b", "b"], "string")}
    return table(spark, more | {name: (["old"] * 5, "string") for name in clashes})


def vectors(spark):
    given = [[1.0, 0.0], [1.0, 1e-9], None, [1e200, 1e200], [1e-170, 1e-170]]
    return table(spark, {"vec_id": (range(5), "long"), "embedding": (given, "array<double>"), "label": ([1] * 5, "int")})


def pages(spark):
    urls = ["http://a.org/x", "https://x.com/de/1", None, "no", "http://a.org/x"]
    return table(spark, {"page_id": (range(5), "long"), "url": (urls, "string"), "html": ([HTML] * 3 + [None, ""], "string")})


def judged(spark):
    d = docs(spark)
    return identify_language(d, fit_languages(language_training(d)))


CASES = {
    "language": (judged, ["lang_pred", "score", "rejected"]),
    "statistics": (lambda spark: with_statistics(docs(spark)), ["statistics"]),
    "html": (lambda spark: extract_text(pages(spark)), ["text", "n_chars"]),
    "near": (lambda spark: mark_near_duplicates(docs(spark)), ["class_id", "class_size", "kept"]),
    "leaks": (lambda spark: find_contamination(docs(spark), spark.createDataFrame([("i", "by the river")], "item_id string, text string")), ["n_words", "hit_words", "items", "spans"]),
    "secrets": (lambda spark: scan_secrets(docs(spark)), ["secrets"]),
    "vectors": (lambda spark: link_vectors(vectors(spark)), ["n_links", "component_id", "kept"]),
    "personal": (lambda spark: replace_personal_data(docs(spark), "k"), ["n_entities", "kinds"]),
    "urls": (lambda spark: judge_urls(pages(spark), fixed_rows(spark, URL_RULES, ["host", "path", "verdict"])), ["host", "path", "rule", "verdict"]),
    "mix": (lambda spark: mix(docs(spark)), ["size", "source_size", "target", "copies", "taken"]),
    "repeats": (lambda spark: remove_repeats(docs(spark), size=3), ["n_words", "n_removed", "kept_text"]),
}


@pytest.mark.parametrize("name", CASES)
def test_odd_columns_are_kept(spark, name):
    run, added = CASES[name]
    got = run(spark)
    assert got.columns[-len(added):] == added and set(ODD) <= set(got.columns)
    rows = got.collect()
    assert len(rows) == 5
    assert all(r[c] == value for r in rows for c, value in ODD.items())


def test_one_of_each_class_keeps_all_columns(spark):
    d = docs(spark)
    got = keep_one(d)
    assert got.columns == d.columns and got.count() == 4
    assert all(r[c] == value for r in got.collect() for c, value in ODD.items())


def test_own_columns_are_replaced(spark):
    got = mix(docs(spark, Copies=1, TAKEN=1))
    assert "Copies" not in got.columns and "TAKEN" not in got.columns and got.columns[-1] == "taken"
    got = identify_language(docs(spark, Score=1), None)
    assert [c for c in got.columns if c.lower() == "score"] == ["score"]


def test_links_of_very_large_and_very_small_vectors(spark):
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in link_vectors(vectors(spark)).collect()}
    assert got == {0: (1, 0), 1: (1, 0), 2: (0, 2), 3: (1, 3), 4: (1, 3)}
    for size in (1e200, 1e-170, 5e-324):
        x, y = usable([size, size])
        assert x == y and 0.5 <= x < 1
    assert usable([0.0, 0.0]) is None and usable([float("nan"), 1.0]) is None
    assert np.allclose(usable([3.0, 4.0]), [0.375, 0.5])


def test_columns_are_renamed_inside_only(spark):
    @any_names("text")
    def shout(df, text="text"):
        assert df.columns == ["c0", "c1", "c2"] and text == "c1"
        return df.selectExpr("c0", f"upper({text}) AS loud")

    df = spark.createDataFrame([(1, "x", "y")], "id int, Text string, LOUD string")
    assert shout(df).columns == ["id", "loud"] and shout(df, text="Text").first()["loud"] == "X"
