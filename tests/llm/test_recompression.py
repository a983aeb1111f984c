"""Substring removal by recompression against brute force."""

import hashlib
import os
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from rackwise.llm import catalogue
from rackwise.llm.recompression import NameFilter, remove_repeats, window_keys, window_symbols, word_names

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LAST = (1 << 63) - 1


def brute(rows, size=13):
    """By plain tuples of words: number of words, of removed ones, and the kept text."""
    split = [(LAST if i is None else i, re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for i, t in rows]
    least = {}
    for i, words in split:
        for k in range(len(words) - size + 1):
            window = tuple(words[k:k + size])
            least[window] = min(least.get(window, i), i)
    out = []
    for i, words in split:
        gone = set()
        for k in range(len(words) - size + 1):
            if least[tuple(words[k:k + size])] < i:
                gone.update(range(k, k + size))
        out.append((len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def test_words_are_named_by_their_bytes():
    texts = [b"one  two\tone", None, b"", b"\n\x0b two\x1cx ", "é one".encode(), b"tail"]
    names, counts = word_names(texts)
    assert counts.tolist() == [3, 0, 0, 1, 2, 1]
    words = [w for t in texts for w in re.findall(rb"[^\x20\x09-\x0D]+", t or b"")]
    assert len({*zip(names.tolist(), words, strict=True)}) == len(set(names.tolist())) == len(set(words))
    long = b" ".join(b"w%d" % (k % 70000) for k in range(300000)) + b" " + b"x" * 700000 + b" w5"
    names, counts = word_names([b"a", long])
    assert counts.tolist() == [1, 300002] and names[1] == names[70001] and names[6] == names[-1]
    assert len(set(names.tolist())) == 70002


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=6, max_size=9), st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(0, 3), max_size=20), st.integers(2, 6), st.integers(1, 4))
def test_a_window_names_itself_whatever_is_around_it(window, before, after, size, rounds):
    size = min(size, len(window))
    names = np.random.default_rng(5).integers(1, 2**63, 4).astype(np.uint64)
    alone = window_symbols(names[np.array(window)], size, rounds)
    inside = window_symbols(names[np.array([*before, *window, *after])], size, rounds)
    assert alone.tolist() == inside[len(before):len(before) + len(alone)].tolist()


def test_symbols_are_few_and_long():
    words = np.random.default_rng(1).integers(1, 2**63, 100_000).astype(np.uint64)
    symbols = window_symbols(words)
    changes = (symbols[1:] != symbols[:-1]).mean()
    assert len(set(symbols.tolist())) / len(words) < 0.3 and changes < 0.3
    assert len({*zip(*(k.tolist() for k in window_keys(words, np.arange(1000))), strict=True)}) == 1000


def test_a_filter_loses_no_name():
    rng = np.random.default_rng(2)
    held = NameFilter(np.zeros(1 << 13, np.uint8))
    x = rng.integers(0, 2**63, 500).astype(np.uint64)
    for place in (x & np.uint64(0xFFFF), x >> np.uint64(32) & np.uint64(0xFFFF)):
        for p in place.tolist():
            held.bits[p >> 3] |= 1 << (p & 7)
    assert held.holds(x).all() and held.holds(rng.integers(0, 2**63, 10_000).astype(np.uint64)).mean() < 0.01


def passages(seed, n=120):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(4000)}"
    shared = [[word() for _ in range(rng.choice([12, 13, 14, 30, 90]))] for _ in range(8)] + [["na"] * 40, ["la", "la", "li"] * 12]
    rows = []
    for k in range(n):
        words = [word() for _ in range(rng.choice([0, 3, 12, 13, 60, 300]))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            part = rng.choice(shared)
            cut = rng.randrange(len(part))
            words[at:at] = rng.choice([part, part[cut:], part[:cut], part + part])
        rows.append((rng.choice([k, k, k, k // 2, None]), rng.choice([" ", "\n", "  \t"]).join(words)))
    long = [word() for _ in range(3000)]
    rows += [(1000, " ".join(long * 3)), (999, " ".join(long[500:2000])), (7, None), (8, ""), (None, None), (1001, " ".join(long * 3)), (1001, " ".join(long * 3))]
    rng.shuffle(rows)
    return rows


def test_repeats_against_brute_force(spark):
    rows = passages(3)
    df = spark.createDataFrame([(*r, k, "m", 2, "old", 5) for k, r in enumerate(rows)], "doc_id long, text string, `a.b` long, _doc string, _body int, Kept_Text string, _hash int")
    got = remove_repeats(df)
    assert got.columns == ["doc_id", "text", "a.b", "_doc", "_body", "_hash", "n_words", "n_removed", "kept_text"]
    want = brute(rows)
    assert sum(n for _, n, _ in want) > 3000
    out = got.repartition(3).orderBy("`a.b`").collect()
    assert [(r["n_words"], r["n_removed"], r["kept_text"].encode()) for r in out] == want
    assert [(r["doc_id"], r["text"], r["_doc"], r["_body"], r["_hash"]) for r in out] == [(*r, "m", 2, 5) for r in rows]
    short = remove_repeats(df, digest=True).orderBy("`a.b`").collect()
    assert [(r["n_words"], r["n_removed"], r["kept_sha256"]) for r in short] == [(n, m, hashlib.sha256(t).hexdigest()) for n, m, t in want]
    small = remove_repeats(df.repartition(5), size=4, rounds=2).orderBy("`a.b`").collect()
    assert [(r["n_words"], r["n_removed"], r["kept_text"].encode()) for r in small] == brute(rows, 4)
    assert remove_repeats(df.limit(0)).collect() == [] and remove_repeats(df.limit(0), digest=True).collect() == []


def test_the_given_documents(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: (n, m, hashlib.sha256(t).hexdigest()) for r, (n, m, t) in zip(rows, brute(rows), strict=True)}
    got = catalogue.op11_substring_dedup(spark, SF)
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got.collect()} == want
    assert any(m for _, m, _ in want.values())
