"""Whitening and token alignment against brute force."""

import hashlib
import math
import os
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rackwise.llm import catalogue
from rackwise.llm.token_alignment import ByteTokenizer, PieceTokenizer, align_tokens, chunks_of
from rackwise.llm.whitening import bit_planes, fit_whitening, identity_error, plane_products, whiten

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TOKENIZERS = "/opt/tokenizers"
ODD_NAMES = "_text string, _row long, _rest string, `a.b` int, _meta string"


# Whitening


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 200), st.integers(1, 4), st.integers(1, 45), st.integers(0, 2**32))
def test_bit_planes_give_exact_products(rows, dim, bits, seed):
    u = np.random.default_rng(seed).integers(0, 1 << bits, (rows, dim))
    sums, products = plane_products(bit_planes(u, bits))
    big = u.astype(object)
    assert sums.tolist() == big.sum(axis=0).tolist()
    want = big.T @ big
    assert all(products[i, j] == want[i, j] for i in range(dim) for j in range(i, dim))


def whole(vector):
    return [math.floor(1024 * float(c)) + 100000 for c in vector]


def brute_whitening(vectors):
    """n, sums, deviations, and the covariance in whole numbers, by plain Python integers."""
    x = [whole(v) for v in vectors]
    n, dim = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(dim)]
    deviation = [sum((n * r[i] - sums[i]) ** 2 for i in range(dim)) for r in x]
    apart = [[n * r[i] - sums[i] for i in range(dim)] for r in x]
    covariance = np.array([[sum(a[i] * a[j] for a in apart) / n**3 for j in range(dim)] for i in range(dim)])
    return n, sums, deviation, covariance, x


def test_whitening_of_the_given_vectors(spark):
    given_rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = catalogue.op12_whitening(spark, SF).collect()
    n, sums, deviation, covariance, x = brute_whitening([r["embedding"] for r in given_rows])
    values, axes = np.linalg.eigh(covariance)
    of = {r["vec_id"]: k for k, r in enumerate(given_rows)}
    assert len(got) == 8 * n and {r["component"] for r in got} == set(range(1, 9))
    white = np.zeros((n, 8))
    for r in got:
        k = of[r["vec_id"]]
        white[k, r["component"] - 1] = r["whitened"]
        assert r["n"] == n and r["deviation"] == deviation[k] and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], values[-r["component"]] / values.sum(), rel_tol=1e-9)
    apart = np.array(x) - np.array(sums) / n
    want = apart @ axes[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    for c in range(8):
        assert min(np.abs(white[:, c] - s * want[:, c]).max() for s in (1, -1)) < 1e-6
    assert np.abs(np.cov(white.T, bias=True) - np.eye(8)).max() < 1e-9


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    fine = [[0.5, 0.25], [0.5, 0.25], [-3.0, 1.0], [1e300, -1e300], [0.001, 7.0]]
    rows = [(k, v, f"t{k}", k, None, 3, "m") for k, v in enumerate([*fine, None, [], [1.0], [None, 1.0], [inf, 0.0], [nan, 0.0]])]
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<double>, {ODD_NAMES}")
    model = fit_whitening(df)
    got = {r["vec_id"]: r for r in whiten(df, model).collect()}
    assert set(got) == {0, 1, 2, 3, 4} and model.n == 5 and model.dim == 2
    assert got[0]["whitened"] == got[1]["whitened"] and got[0]["a.b"] == 3 and got[4]["_text"] == "t4"
    assert got[3]["deviation"] is None and got[0]["deviation"] is None  # beyond a long
    small = df.where("vec_id in (0, 1, 2, 4)")
    model = fit_whitening(small)
    n, sums, deviation, _, _ = brute_whitening([fine[k] for k in (0, 1, 2, 4)])
    out = whiten(small, model)
    assert sorted(r["deviation"] for r in out.collect()) == sorted(deviation) and model.sums == sums
    assert identity_error(out, len(model.variances)) < 1e-9


def test_vectors_without_variance(spark):
    schema = "vec_id long, embedding array<float>, n string"
    for rows in ([], [(1, None, "x")], [(1, [1.0, 2.0], "x"), (2, [1.0, 2.0], "y")]):
        df = spark.createDataFrame(rows, schema)
        assert fit_whitening(df) is None and whiten(df, None).collect() == []
        assert whiten(df, None).columns == ["vec_id", "embedding", "n", "deviation", "whitened"]
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0], "") for k in range(9)], schema)
    assert len(fit_whitening(line).variances) == 1


# Token alignment


def brute_alignment(texts):
    """By whole texts, one offset at a time, with the plain tokenizer libraries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    a.encode_special_tokens = True
    b = SentencePieceProcessor(model_file=f"{TOKENIZERS}/piece_bpe_32k.model")
    a_bytes = ByteTokenizer(f"{TOKENIZERS}/byte_bpe_50k.json").bytes_of
    docs, counts = [], Counter()
    for text in texts:
        groups, links = [], []
        if text:
            a_ids, b_ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            a_parts = [a_bytes[i] for i in a_ids]
            b_parts = [bytes([int(p[3:-1], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in b_ids)]
            if b"".join(a_parts) == b"".join(b_parts) == (" " + text).encode():
                a_ends, b_ends = ([sum(map(len, parts[:k + 1])) for k in range(len(parts))] for parts in (a_parts, b_parts))
                links = [(a_ids[a_ends.index(e)], b_ids[b_ends.index(e)]) for e in a_ends if e in set(b_ends)]
                low = 0
                for e in [e for e in a_ends if e in set(b_ends)]:
                    groups.append(([i for i, x in zip(a_ids, a_ends) if low < x <= e], [i for i, x in zip(b_ids, b_ends) if low < x <= e]))
                    low = e
        counts.update(links)
        docs.append((groups, links))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for groups, links in docs:
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                    sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
                    hashlib.sha256(shown.encode()).hexdigest() if groups else ""))
    return out


ODD_TEXTS = [
    None, "", " ", "   ", "a", "a b", "two  spaces", "tail ", "tail  ", "\n\nlines\n here\r\nend;\r", "\ttab\t", "x▁y", "▁", "a <|endoftext|> b</s><s><unk>",
    "no break　wide ﬁ é é ́", "\u0085q   z", "中文 字符 と かな", "🙂🙂 🙂", "a\x00b", "\x1c x", "don't we'll 12 345", "z" * 3000, "1" * 700,
    "x ​ y", "same same same same", "a b", "Ünï cödé  \n",
]


def shown(df):
    return [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.orderBy("doc_id").collect()]


def test_alignment_of_odd_texts(spark):
    rows = [(k, t, f"t{k}", k, None, 3, "m") for k, t in enumerate(ODD_TEXTS)]
    df = spark.createDataFrame(rows, f"doc_id long, text string, {ODD_NAMES}")
    want = brute_alignment(ODD_TEXTS)
    got = align_tokens(df, TOKENIZERS)
    assert shown(got) == want
    assert [(r["text"], r["_row"], r["a.b"]) for r in got.orderBy("doc_id").collect()] == [(t, k, 3) for k, t in enumerate(ODD_TEXTS)]
    assert shown(align_tokens(df, TOKENIZERS, head_pairs=3)) == want  # most pairs by join
    assert shown(align_tokens(df.select("doc_id", "text"), TOKENIZERS, head_pairs=0, keep_text=False)) == want
    assert align_tokens(df.limit(0), TOKENIZERS).collect() == []
    clash = df.select("doc_id", "text", F.lit("old").alias("N_Best"))
    assert align_tokens(clash, TOKENIZERS).columns == ["doc_id", "text", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_alignment_of_bytes_that_are_no_text(spark):
    df = spark.createDataFrame([(1,)], "doc_id long").select("doc_id", F.unhex(F.lit("41ff42")).cast("string").alias("text"))
    assert shown(align_tokens(df, TOKENIZERS, keep_text=False)) == [(0, 0, 0, 0, 0, 0, "")]


def test_alignment_of_the_given_documents(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    short = [t if t is None or len(t) < 4000 else t[:4000] for t in texts][:60]  # the brute force is quadratic
    df = spark.createDataFrame(list(enumerate(short)), "doc_id long, text string")
    assert shown(align_tokens(df, TOKENIZERS)) == brute_alignment(short)
    assert catalogue.op13_token_alignment(spark, SF).count() == len(texts)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é\n\t\r .;'1中▁ \x1c🙂"), max_size=40))
def test_chunks_encode_like_the_whole(text):
    if not text:
        return
    chunks = chunks_of(text)
    assert " ".join(chunks) == text
    a, b = _tokenizers()
    assert [i for c in chunks for i in a.encode(" " + c).tolist()] == a.encode(" " + text).tolist()
    if "▁" not in text:
        assert [i for c in chunks for i in b.encode(c).tolist()] == b.encode(text).tolist()


def test_ranked_tokens_equal_the_library(spark):
    from tokenizers import Tokenizer

    whole_file = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    whole_file.encode_special_tokens = True
    texts = [t for t in ODD_TEXTS if t]
    assert [_tokenizers()[0].encode(t).tolist() for t in texts] == [e.ids for e in whole_file.encode_batch(texts, add_special_tokens=False)]


_HELD = []


def _tokenizers():
    if not _HELD:
        _HELD.extend([ByteTokenizer(f"{TOKENIZERS}/byte_bpe_50k.json"), PieceTokenizer(f"{TOKENIZERS}/piece_bpe_32k.model")])
    return _HELD


@pytest.mark.parametrize("name", ["op12_whitening", "op13_token_alignment"])
def test_queries_are_registered(name):
    assert name in catalogue.QUERIES
