"""Operators over the whole corpus: near copies, decontamination, vectors, personal data, mixing, the pipeline."""

import os
import random
import re
import time
from ipaddress import IPv6Address

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from rackwise.llm import catalogue
from rackwise.llm.components import components
from rackwise.llm.decontamination import FMIndex, find_contamination, remove_spans, stretches, suffix_order
from rackwise.llm.embedding_join import blocks_of, link_vectors, rotation
from rackwise.llm.mixing import mix, pivotal, source_targets
from rackwise.llm.near_duplicates import _edits, _edits_by_rows, alignment_similarity, keep_one, labelled, mark_near_duplicates, order_sketches, shingle_hashes
from rackwise.llm.pii import find_entities, luhn, replace_personal_data, rewrite, settle, surrogate

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Groups:
    """Union-find for the brute-force versions."""

    def __init__(self):
        self.up = {}

    def root(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.root(a), self.root(b)))
        self.up[b] = a


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 140)] + [(7, 7), (500, 400), (400, 500)]
    groups = Groups()
    for a, b in pairs:
        if a != b:
            groups.join(a, b)
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: groups.root(x) for x in groups.up}


# Near copies

WORDS = [f"w{i}" for i in range(400)]


def _changed(words, rng, share):
    out = list(words)
    for i in rng.sample(range(len(out)), int(len(out) * share)):
        out[i] = rng.choice(WORDS) + "x"
    return out


def _plain_similarity(a, b):
    table = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
    m = table[-1, -1]
    return m / (len(a) + len(b) - m) if len(a) and len(b) else 0.0


@settings(deadline=None, max_examples=80)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25), st.floats(0.1, 1))
def test_alignment_equals_the_full_table(a, b, least):
    full = _plain_similarity(a, b)
    got = alignment_similarity(np.array(a, np.uint64), np.array(b, np.uint64), least)
    assert got == pytest.approx(full) if full >= least + 1e-9 else got == 0 or got == pytest.approx(full)


@settings(deadline=None, max_examples=300)
@given(st.lists(st.integers(0, 9), max_size=60), st.lists(st.integers(0, 9), max_size=60), st.integers(0, 130))
def test_edits_within_any_band(a, b, most):
    aligned = [0] * (len(b) + 1)
    for x in a:
        before = list(aligned)
        for j, y in enumerate(b):
            aligned[j + 1] = before[j] + 1 if x == y else max(before[j + 1], aligned[j])
    want = min(len(a) + len(b) - 2 * aligned[-1], most + 1)
    assert _edits(a, b, most) == _edits_by_rows(a, b, most) == want


@pytest.mark.parametrize("kinds", [3, 1 << 40])
def test_very_long_texts_align_in_time(kinds):
    rng = random.Random(5)
    one = [rng.randrange(kinds) for _ in range(200_000)]
    other = [x for x in one if rng.random() > 0.04]
    for k in range(0, len(other), 25):
        other[k] = kinds + k
    begun = time.monotonic()
    assert alignment_similarity(np.array(one, np.uint64), np.array(other, np.uint64), 0.8) >= 0.8
    assert time.monotonic() - begun < 60


def test_sketches_know_order_and_repeats():
    words = WORDS[:60]
    assert order_sketches(" ".join(words)) == order_sketches(" ".join(words).upper() + "!")
    assert not set(order_sketches(" ".join(words))) & set(order_sketches(" ".join(WORDS[100:160])))
    assert len(set(labelled(shingle_hashes("a b c d e " * 9)).tolist())) == 41
    assert order_sketches("") == order_sketches("...") == [] and len(order_sketches("one")) == 14


def _near_docs():
    rng = random.Random(4)
    docs = []
    for _ in range(6):
        base = [rng.choice(WORDS) for _ in range(rng.randint(80, 200))]
        docs += [" ".join(_changed(base, rng, s)) for s in (0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.2)]
    passage = " ".join(rng.choice(WORDS) for _ in range(60))
    docs += [" ".join([passage, *(rng.choice(WORDS) for _ in range(30))]) for _ in range(25)]
    docs += [docs[0]] * 30 + [docs[0].upper() + " ."] + ["", "", "!!", "one two", "One two.", "x " * 30_000, "x " * 29_990]
    rng.shuffle(docs)
    return docs


def test_classes_equal_brute_force(spark):
    docs = _near_docs()
    hashes, groups = [shingle_hashes(t) for t in docs], Groups()
    for i in range(len(docs)):
        groups.root(i)
        for j in range(i):
            shared = docs[i] == docs[j] or alignment_similarity(hashes[i], hashes[j], 0.8) >= 0.8
            if shared:
                groups.join(i, j)
    frame = spark.createDataFrame([(i, t, "c") for i, t in enumerate(docs)], "doc_id long, text string, kept string")
    got = {r.doc_id: (r.class_id, r.kept) for r in mark_near_duplicates(frame).collect()}
    assert got == {i: (groups.root(i), groups.root(i) == i) for i in range(len(docs))}
    assert sorted(r.doc_id for r in keep_one(frame).collect()) == sorted({groups.root(i) for i in range(len(docs))})


def test_near_copies_of_odd_rows(spark):
    rows = [(1, None), (2, None), (3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f g h"), (None, "a b c d e f g h"), (9, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.class_id), r.class_size, r.kept) for r in mark_near_duplicates(frame).collect())
    assert got == sorted([("1", "1", 1, True), ("2", "2", 1, True), ("3", "3", 2, True), ("3", "3", 2, True), ("None", "None", 2, True), ("None", "None", 2, True), ("9", "9", 1, True)])
    assert keep_one(frame).count() == 5 and keep_one(frame.limit(0)).count() == 0
    assert mark_near_duplicates(frame.limit(0)).count() == 0


# Decontamination

@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=60), st.lists(st.lists(st.integers(1, 3), min_size=1, max_size=4), min_size=1, max_size=8), st.integers(1, 5))
def test_index_finds_every_occurrence(text, patterns, every):
    index = FMIndex(np.array(text), 4, every)
    table = np.zeros((len(patterns), 4), int)
    for i, p in enumerate(patterns):
        table[i, :len(p)] = p
    low, high = index.search(table, np.array([len(p) for p in patterns]))
    for p, a, b in zip(patterns, low, high, strict=True):
        found = sorted(index.locate(np.arange(a, b)).tolist())
        assert found == [i for i in range(len(text)) if text[i:i + len(p)] == p]


def test_suffix_order_of_long_repeats():
    text = np.array([1, 2] * 500 + [0] + [1, 2] * 400 + [1])
    rank = {i: (0, i) for i in range(len(text))}
    order = suffix_order(text).tolist()
    assert sorted(order) == sorted(rank)
    key = [[(int(s), int(p) if s == 0 else 0) for p, s in enumerate(text) if p >= i] for i in order]
    assert key == sorted(key)


def _plain_words(text):
    return WORD.findall((text or "").translate(FOLD))


def _plain_hits(text, items, window=10):
    words, hits, names = _plain_words(text), set(), set()
    for name, body in items:
        item = _plain_words(body)
        for k in range(max(1, len(item) - window + 1) if item else 0):
            w = item[k:k + window]
            for i in range(len(words) - len(w) + 1):
                if words[i:i + len(w)] == w:
                    hits.update(range(i, i + len(w)))
                    names.add(name)
    return len(words), sorted(hits), sorted(names)


def _without_hits(text, hits):
    """``text`` without the stretches of hit words, by the words' places."""
    places, out, at = [m.span() for m in WORD.finditer(text.translate(FOLD))], "", 0
    for i, n in enumerate(hits):
        if not i or hits[i - 1] < n - 1:
            out += text[at:places[n][0]]
        at = places[n][1]
    return out + text[at:]


def test_contamination_equals_brute_force(spark):
    rng = random.Random(2)
    few = [f"v{i}" for i in range(3)]
    items = [("10", " ".join(rng.choice(few) for _ in range(14))), ("9", " ".join(rng.choice(WORDS) for _ in range(40))), ("2", "Ünïted, front\x00door"), ("3", ""), ("4", "..."), ("9", "solo!"), ("1", "SOLO")]
    texts = [None, "", "...", " ".join(rng.choice(few) for _ in range(3000)), "x ünïted Front-DOOR y", "Ünïted front door", items[1][1].upper() + " zz " + items[1][1], "solo", "a.b " * 50_000 + items[0][1] + "!", "\ud83d😀 solo", "solo", "日本 é solo. " * 700 + items[0][1] + " ünïted front_door"]
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id int, text string, items int")
    tests = spark.createDataFrame([*items, (None, "solo"), ("77", None)], "item_id string, text string")
    for block, shard in ((400, 500), (1 << 20, 1 << 18)):
        got = {r.doc_id: r for r in find_contamination(docs, tests, block_bytes=block, shard_words=shard).withColumn("rest", remove_spans(F.col("text"), F.col("spans"))).collect()}
        for i, t in enumerate(texts):
            wanted = _plain_hits(t, items)
            assert (got[i].n_words, got[i].hit_words, got[i]["items"]) == wanted
            assert got[i].rest == (None if t is None else _without_hits(t, wanted[1]))
    assert got[4].rest == texts[4] and got[5].rest == "" and got[6].rest == " zz "
    assert find_contamination(docs.limit(0), tests).count() == 0
    assert find_contamination(docs, tests.limit(0)).where(F.size("hit_words") > 0).count() == 0
    assert find_contamination(docs, tests.where("item_id in ('3', '4')")).where("n_words > 0 and size(spans) = 0").count() == len(texts) - 3


class _Known:
    def __init__(self, bad):
        self.bad = bad

    def holds(self, names):
        return ~np.isin(names, self.bad)


def test_stretches_keep_places_in_characters():
    texts = [b"", "É b, c".encode(), b"b", "x ÉÉ  Q".encode()]
    name, text, number, start, stop = stretches(texts, _Known([]), 2)
    assert [(t, n, a, b) for x, t, n, a, b in zip(name, text, number, start, stop) if x] == [(1, 0, 0, 1), (1, 1, 2, 3), (1, 2, 5, 6), (3, 0, 0, 1), (3, 1, 2, 4), (3, 2, 6, 7)]
    bad = name[1]  # b
    assert [len(c) for c in stretches(texts, _Known([bad]), 2)] == [4] * 5
    assert [len(c) for c in stretches(texts, _Known([bad]), 4)] == [0] * 5
    assert [len(c) for c in stretches([b"", b"..."], _Known([]), 1)] == [0] * 5


# Vectors

def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    rows, centres = [], rng.normal(size=(8, 24))
    for i in range(160):
        v = centres[i % 8] + rng.normal(size=24) * (0.03 + 0.06 * (i % 3))
        rows.append([i, (v * (1 + i % 4)).tolist(), i % 2])
    rows += [[200 + i, rows[0][1], 0] for i in range(25)]
    rows += [[300, None, 0], [301, [0.0] * 24, 0], [302, [float("nan")] * 24, 0], [303, [None] * 24, 0], [304, rows[0][1], None], [305, [], 0], [306, [1.0, 2.0], 0], [307, [1.0, 2.0], 0], [308, [1.0], 1], [306, [1.0, 2.0], 0]]
    frame = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "vec_id long, embedding array<double>, label int, kept string")

    def unit(v):
        ok = v and None not in v and np.isfinite(v).all() and np.linalg.norm(v) > 0
        return np.array(v) / np.linalg.norm(v) if ok else None

    groups, units = Groups(), [unit(v) for _, v, _ in rows]
    count = [0] * len(rows)
    for i in range(len(rows)):
        groups.root(rows[i][0])
        for j in range(i):
            a, b = units[i], units[j]
            if a is not None and b is not None and len(a) == len(b) and rows[i][2] == rows[j][2] and rows[i][2] is not None and a @ b >= 0.98:
                count[i] += 1
                count[j] += 1
                groups.join(rows[i][0], rows[j][0])
    want = sorted((r[0], n, groups.root(r[0]), groups.root(r[0]) == r[0]) for r, n in zip(rows, count, strict=True))
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in link_vectors(frame).collect())
    assert got == want
    assert link_vectors(frame.limit(0)).count() == 0


def test_rotation_keeps_lengths_and_blocks_cover():
    assert np.allclose(rotation(20) @ rotation(20).T, np.eye(20))
    assert blocks_of(20) == [(0, 8), (8, 16), (16, 20)]


# Personal data

def test_entities_and_their_surrogates():
    text = "Mail John.Doe@mail.example.com or JOHN.DOE@mail.example.com, +1 (456) 555-2186 or +14565552186; 4111 1111 1111 1111, 300.1.1.1, 10.2.33.144. Mrs Anna Schmidt, Herr MÜLLER."
    new, kinds = rewrite(text, "k", {})
    assert kinds == ["email", "email", "phone", "phone", "card", "ip", "given-f", "surname", "surname"]
    emails = re.findall(r"\S+@\S+[a-z]", new)
    assert emails[0] == emails[1] and emails[0].endswith(".com") and "doe" not in emails[0]
    phones = re.findall(r"\+1[ ()\d-]+\d", new)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", phones[0]) and re.sub(r"\D", "", phones[0]) == re.sub(r"\D", "", phones[1])
    card = re.search(r"4\d{3} \d{4} \d{4} \d{4}", new)[0]
    assert luhn(card.replace(" ", "")) == 0 and card != "4111 1111 1111 1111"
    assert "300.1.1.1" in new and "10.2.33.144" not in new and re.search(r"Mrs [A-Z][a-z]+a [A-Z][a-z]+, Herr [A-Z]+\.", new)
    assert rewrite(text, "other", {})[0] != new and rewrite(text, "k", {})[0] == new
    assert rewrite("Version 2.0. The house, 1999, 12.5 %, a@b.", "k", {}) == ("Version 2.0. The house, 1999, 12.5 %, a@b.", [])
    russian = rewrite("Госпожа Анна Петрова", "k", {})[0]
    assert russian.startswith("Госпожа ") and re.search("[а-я]", russian.split()[1])


def test_addresses_of_eight_groups():
    text = "From 2001:db8::8a2e:370:7334, [2001:DB8:0:0:0:8A2E:0370:7334]:80 and fe80::1c: up; 2001:0db8:0000:0000:0000:8a2e:0370:7334."
    new, kinds = rewrite(text, "k", {})
    assert kinds == ["ip6"] * 4
    one, two, three, four = re.findall(r"[0-9a-fA-F]{4}:[0-9a-fA-F:]*[0-9a-fA-F]", new)
    full = IPv6Address("2001:db8::8a2e:370:7334").exploded
    assert IPv6Address(one) == IPv6Address(two) == IPv6Address(four) != IPv6Address(full)
    assert re.fullmatch(r"[0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{3}:[0-9a-f]{4}", one) and two.isupper() and len(four) == 39
    assert re.sub("[0-9a-f]", "x", three) == "xxxx::xx" and three != "fe80::1c" and new[len(new) - 40:-1] == four
    for plain in ("a[1::2] of x[::3], std::map and C::D", "at 12:30:45 on 01:02:03:04:05:06", "::1 or ::", "1:2:3:4:5:6:7:8:9", "12345::1:2:3", "a:b::c::d"):
        assert rewrite(plain, "k", {}) == (plain, [])
    assert rewrite("::ffff:10.2.33.144", "k", {})[1] == ["ip"]
    rendered = [surrogate("k", "ip6", full, a) for a in range(60)]
    assert len(set(rendered)) == 60 and all(IPv6Address(x).exploded == x for x in rendered)


@pytest.mark.parametrize(("kind", "canonical"), [("ip6", "fe80:0000:0000:0000:0000:0000:0000:001c"), ("iban", "DE89370400440532013000"), ("ssn", "123456789"), ("card", "4041894974608795"), ("ip", "9.9.9.9"), ("given-f", "анна")])
def test_surrogates_keep_the_form(kind, canonical):
    seen = {surrogate("k", kind, canonical, a) for a in range(40)}
    assert len(seen) > 20 and canonical not in seen
    if kind == "iban":
        assert all(int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1 and len(s) == 22 for s in seen)
    if kind == "card":
        assert all(len(s) == 16 and (luhn(s) == 0) == (luhn(canonical) == 0) for s in seen)


def test_collisions_are_settled(spark):
    # Octets of one digit leave 6,561 addresses: 1,500 of them can't all draw well at once.
    rng = random.Random(3)
    ips = {".".join(str(rng.randint(1, 9)) for _ in range(4)) for _ in range(1500)}
    got = settle(spark.createDataFrame([("ip", x) for x in ips], "kind string, canonical string"), "k").collect()
    out = [r.surrogate for r in got]
    assert len(out) == len(set(out)) == len(ips) and not ips & set(out) and max(r.attempt for r in got) > 0


def test_collisions_reach_the_texts(spark):
    rng = random.Random(3)
    ips = sorted({".".join(str(rng.randint(1, 9)) for _ in range(4)) for _ in range(1500)})
    docs = spark.createDataFrame([(i, f"at {x} and {ips[0]}", "k") for i, x in enumerate(ips)] + [(None, None, None), (-1, "", "")], "doc_id long, text string, kinds string")
    got = {r.doc_id: r for r in replace_personal_data(docs, "k").collect()}
    words = {i: r.text.split() for i, r in got.items() if r.text}
    assert len({w[1] for w in words.values()}) == len(ips) and len({w[3] for w in words.values()}) == 1
    assert got[None].text is None and got[None].n_entities == 0 and got[-1].text == "" and got[5].n_entities == 2
    assert replace_personal_data(docs.limit(0), "k").count() == 0


def test_nothing_personal_is_left(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.col("text").alias("old"))
    got = catalogue.QUERIES["op8_personal_data"](spark, SF).join(docs, "doc_id").collect()
    old = {x[3] for r in got for x in find_entities(r.old)}
    new = [x[3] for r in got for x in find_entities(r.text)]
    assert old and not old & set(new)
    assert all(r.text == r.old for r in got if not r.n_entities)


# Mixing

@settings(deadline=None, max_examples=80)
@given(st.lists(st.floats(0, 1), max_size=40), st.integers(0, 1000))
def test_pivotal_rounding_keeps_the_mass(chances, seed):
    p = np.array(chances, float)
    out, held = pivotal(p.copy(), np.random.default_rng(seed).random(len(p)))
    assert all(x in (0, 1) or i == held for i, x in enumerate(out))
    assert abs(p.sum() - (out == 1).sum()) < 1 + 1e-6


def test_pivotal_rounding_keeps_each_chance():
    p = np.array([0.2, 0.7, 0.5, 0.35, 0.25])
    rng = np.random.default_rng(0)
    total = sum((pivotal(p.copy(), rng.random(5))[0] == 1).astype(float) for _ in range(4000)) / 4000
    assert np.abs(total - p).max() < 0.04


def _plain_targets(sizes, weights=(3, 1, 2)):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-32-be")) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, out = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / w > 2 * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / w for s in open_}
        out |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    names = ["", "a", "B", "é", "😀", "�", None, "z1"][: 3 + seed * 2]
    rows = [(s, rng.choice([0, 1, 5, 40, 300]) * rng.randint(0, 9)) for s in names for _ in range(5)]
    sizes = {s: sum(n for t, n in rows if t == s) for s in names}
    got = {r.source: r.target for r in source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    want = _plain_targets(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * int(rng.expovariate(0.02))), "hot" if i % 3 == 0 else f"s{i % 5}") for i in range(6000)]
    rows += [(None, None, None), (1, "w w", None), (1, "w w", None), (-5, "", "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("Size", F.lit("x"))
    got = mix(docs, group_docs=100, tree_width=4).collect()
    again = mix(docs.repartition(13), group_docs=100, tree_width=4).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(3, 0.03 * own[0].target)
        assert abs(sum(r.copies for r in own) - len(own) * own[0].target / max(1, own[0].source_size)) < 1 + 1e-6
    assert all(r.taken == r.copies * r.size and r.copies <= 2 for r in got)
    assert mix(docs.limit(0)).count() == 0


def test_rows_of_one_id_share_their_copies(spark):
    rows = [(None, f"w w w{i % 700}", "a") for i in range(1000)] + [(i, "w " * (i % 50), "b") for i in range(500)] + [(1, "w", "c")] * 101
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("more", F.create_map(F.lit("k"), "text"))
    got = [(r.doc_id, r.text, r.source, r.copies, r.more["k"]) for r in mix(docs, group_docs=50, tree_width=4).collect()]
    again = [(r.doc_id, r.text, r.source, r.copies, r.more["k"]) for r in mix(docs.repartition(7), group_docs=50, tree_width=4).collect()]
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    assert sorted(map(str, (x[:3] for x in got))) == sorted(map(str, rows)) and all(x[1] == x[4] for x in got)
    targets = {r.source: r for r in source_targets(docs.select("source", F.size(F.filter(F.split("text", " "), lambda w: w != "")).cast("long").alias("size"))).collect()}
    for source, t in targets.items():
        own = [x[3] for x in got if x[2] == source]
        assert abs(sum(own) - len(own) * t.target / t.source_size) < 1 + 1e-6
        assert max(own) - min(own) <= 1


# Pipeline

def test_stages_keep_the_columns_and_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**12, None, "en", None, 3), (10**12 + 1, "混じり気のない" * 50, None, "q", 0)], docs.schema)
    docs = docs.unionByName(odd)
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).checkpoint()
        assert docs.columns == columns
        seen[name] = docs.count()
    assert seen["near_duplicates"] < seen["language"] and seen["near_duplicates"] == seen["personal_data"]
    assert docs.where("doc_id >= 1000000000000").count() == 0
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert find_contamination(docs, benchmark).where(F.size("hit_words") > 0).count() <= 1
    assert mark_near_duplicates(docs).where("not kept").count() <= 1
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert set(columns) < set(last.columns) and last.where("copies < 1").count() == 0
    taken, = last.agg(F.sum("taken")).first()
    words, = docs.agg(F.sum(F.size(F.split("text", r"\s+")))).first()
    assert abs(taken - 1.5 * words) < 0.2 * words


def test_the_mix_query_reads_each_text_once(spark, tmp_path):
    rows = [(k, "word " * (k % 7), ("a", "b", None)[k % 3]) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalogue.op10_mix(spark, str(tmp_path))
    assert not [f for f in got.inputFiles() if "documents.parquet" in f]  # what is left to run reads stored sizes only
    assert sorted((r.doc_id, r.size) for r in got.collect()) == [(k, k % 7) for k in range(60)]
