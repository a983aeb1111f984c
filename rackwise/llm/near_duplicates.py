"""Near-duplicate documents: order MinHash sketches propose pairs, banded alignment verifies them."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rackwise.llm.common import add_columns, stored, unused, without
from rackwise.llm.components import components

SHINGLE, SKETCHES, PICKED, SIMILARITY = 5, 14, 3, 0.8
BINS, BLOCK_NODES, FEW = 256, 1500, 64
_SPACED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_SHIFT = np.uint64(33)
_CELLS = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _M1
    x = (x ^ (x >> _SHIFT)) * _M2
    return x ^ (x >> _SHIFT)


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of every run of ``size`` words, lower-cased, in text order; a shorter text is one run, no words none."""
    words = text.lower().encode("utf-8", "replace").translate(_SPACED).split()
    if not words:
        return np.zeros(0, np.uint64)
    known: dict[bytes, int] = {}
    digest = xxhash.xxh3_64_intdigest
    for w in words:
        if w not in known:
            known[w] = digest(w)
    hashed = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = max(1, len(hashed) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(size, len(hashed))):
        out = _mixed(out + hashed[k:k + n])
    return out


def labelled(hashes: np.ndarray) -> np.ndarray:
    """Each hash mixed with how often it has occurred before, so that repeats differ."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    before = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
    out = np.empty_like(hashes)
    out[order] = _mixed(ordered + before.astype(np.uint64) * _M1)
    return out


def order_sketches(text: str, sketches: int = SKETCHES, picked: int = PICKED, marks: np.ndarray | None = None) -> list[int]:
    """For each of ``sketches`` hash functions: the ``picked`` labelled shingles of least hash, in text order, as one number."""
    x = labelled(shingle_hashes(text)) if marks is None else marks
    if not len(x):
        return []
    seeds = np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out, at_once = [], max(1, _CELLS // len(x))
    for at in range(0, sketches, at_once):
        values = seeds[at:at + at_once]
        h = _mixed(x[None, :] ^ values[:, None])
        places = np.sort(np.argpartition(h, picked - 1, axis=1)[:, :picked], axis=1) if len(x) > picked else np.tile(np.arange(len(x)), (len(values), 1))
        for column in x[places].T:
            values = _mixed(values + column)
        out += values.view(np.int64).tolist()
    return out


def _sketches(texts: list) -> list:
    return [[order_sketches(text) if text is not None else None for text in texts]]


def _bins(x: np.ndarray) -> np.ndarray:
    """How many labelled runs fall into each of ``BINS`` bins."""
    return np.bincount((labelled(x) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS)


def alignment_similarity(a: np.ndarray, b: np.ndarray, least: float) -> float:
    """Shingles aligned in order, over all shingles of both (aligned ones once); 0.0 if below ``least``.

    The alignment covers only the band of diagonals that as many insertions and deletions can reach
    as ``least`` allows, a row of it at a time.
    """
    na, nb = len(a), len(b)
    if not na or not nb:
        return 0.0
    most = int((na + nb) * (1 - 2 * least / (1 + least)) + 1e-9)
    if abs(na - nb) > most or na + nb - 2 * len(np.intersect1d(labelled(a), labelled(b), assume_unique=True)) > most:
        return 0.0
    n = min(na, nb)
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    x, y = a[head:], b[head:]
    n = min(len(x), len(y))
    same = x[len(x) - n:][::-1] == y[len(y) - n:][::-1]
    tail = n if same.all() else int(same.argmin())
    x, y = x[:len(x) - tail].tolist(), y[:len(y) - tail].tolist()
    edits = _edits(x, y, most)
    if edits > most:
        return 0.0
    aligned = (na + nb - edits) // 2
    return aligned / (na + nb - aligned)


def _edits(x: list, y: list, most: int) -> int:
    """Least number of insertions and deletions from ``x`` to ``y``; ``most`` + 1 if there are more.

    Furthest points first, whose steps grow with the square of the edits; more than ``FEW`` edits are counted row by row.
    """
    nx, ny = len(x), len(y)
    reach = {1: 0}
    for d in range(min(most, FEW) + 1):
        for k in range(-d, d + 1, 2):
            i = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            j = i - k
            while i < nx and j < ny and x[i] == y[j]:
                i += 1
                j += 1
            reach[k] = i
            if i >= nx and j >= ny:
                return d
    return most + 1 if most <= FEW else _edits_by_rows(x, y, most)


def _edits_by_rows(x: list, y: list, most: int) -> int:
    """As ``_edits``, in time that grows with the length of ``y`` times the band.

    A row of the alignment table is one number: a bit for each place of ``x`` in the band, 0 where one
    more run of ``x`` aligns than before it. A step along ``y`` is an addition; the band moves on by a bit.
    """
    longer = len(x) - len(y)
    if abs(longer) > most:
        return most + 1
    below = (most - longer) // 2  # how far the place in x may lie behind that in y
    width = below + (most + longer) // 2 + 1
    full = (1 << width) - 1
    places: dict = {}
    for i, run in enumerate(x):
        places.setdefault(run, []).append(i)
    places = {run: at if len(at) <= 8 else np.array(at) for run, at in places.items()}
    row, low, aligned = full, -below, 0
    for j, run in enumerate(y):
        at = places.get(run)
        if at is None:
            continue
        ahead = j - below - low
        if ahead >= width:
            aligned += width - row.bit_count()
            row = full
        elif ahead:
            passed = (1 << ahead) - 1
            aligned += ahead - (row & passed).bit_count()
            row = row >> ahead | passed << (width - ahead)
        low = j - below
        same = row & _bits_at(at, low, width)
        if same:
            row = (row + same | row - same) & full
    aligned += width - row.bit_count()
    return min(len(x) + len(y) - 2 * aligned, most + 1)


def _bits_at(places: list | np.ndarray, low: int, width: int) -> int:
    """A bit for each of the ascending ``places`` from ``low`` on, as far as ``width`` reaches."""
    if isinstance(places, list):
        return sum(1 << (i - low) for i in places if low <= i < low + width)
    first, last = np.searchsorted(places, (low, low + width))
    bits = np.zeros(width, bool)
    bits[places[first:last] - low] = True
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (``a``, ``b``) whose texts align; ``texts`` has a row (``node``, ``body``) for each node."""
    both = (
        pairs.join(texts.select(F.col("node").alias("b"), F.col("body").alias("body_b")), "b")
        .join(texts.select(F.col("node").alias("a"), F.col("body").alias("body_a")), "a")
    )

    def setup():
        last: list = [None, None]

        def judge(ones: list, others: list) -> list:
            out = []
            for one, other in zip(ones, others, strict=True):
                if one != last[0]:
                    last[:] = [one, shingle_hashes(one)]
                out.append(alignment_similarity(last[1], shingle_hashes(other), least))
            return [out]

        return judge

    fields = [T.StructField("similarity", T.DoubleType())]
    return add_columns(both.select("a", "b", "body_a", "body_b"), setup, ["body_a", "body_b"], fields, ["body_a", "body_b"]).where(F.col("similarity") >= least)


def _links_across(table: pa.Table, least: float) -> pa.Table:
    """Links between different parts of one bucket, or of two blocks of it.

    Two texts differ in at least as many runs as the counts of their runs by bins differ; that
    excludes nearly all pairs below ``least`` and none above it. What is left is aligned, unless a
    link found before has already brought the two into one part. So only links go out, fewer than
    there are members, and no pair of different parts is left untried.
    """
    side = table["side"].to_numpy()
    node, bodies = table["node"].to_pylist(), table["body"]
    _, part = np.unique(np.array(table["part"].to_pylist()), return_inverse=True)

    @lru_cache(maxsize=64)
    def hashes(k: int) -> np.ndarray:
        return shingle_hashes(bodies[k].as_py())

    n = np.zeros(len(node), np.int64)
    bins = np.zeros((len(node), BINS), np.int32)
    for k in range(len(node)):
        x = hashes(k)
        n[k], bins[k] = len(x), _bins(x)
    rows = np.flatnonzero(side <= 0)
    columns = np.flatnonzero(side > 0) if (side > 0).any() else rows
    share = 1 - 2 * least / (1 + least)
    left, right = [], []
    for i in rows.tolist():
        others = columns[(part[columns] != part[i]) & (np.abs(n[columns] - n[i]) <= share * (n[columns] + n[i]) + 1e-9)]
        if side[i] < 0:
            others = others[others > i]
        for at in range(0, len(others), 4096):
            some = others[at:at + 4096]
            gap = np.abs(bins[some] - bins[i]).sum(axis=1)
            for j in some[gap <= share * (n[some] + n[i]) + 1e-9].tolist():
                if part[i] != part[j] and alignment_similarity(hashes(i), hashes(j), least) >= least:
                    left.append(node[i])
                    right.append(node[j])
                    part[part == part[j]] = part[i]
    return pa.table({"a": pa.array(left, pa.string()), "b": pa.array(right, pa.string())})


def _rest_links(members: DataFrame, least: float, block: int = BLOCK_NODES) -> DataFrame:
    """Links within buckets (``turn``, ``sketch``, ``node``, ``part``, ``body``) between different parts.

    A bucket of more than ``block`` members is cut into blocks, and each pair of blocks is a task's work.
    """
    sizes = members.groupBy("turn", "sketch").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.join(stored(sizes, "rest-sizes"), ["turn", "sketch"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # Side -1: a block with itself; 0 and 1: the first and the second of two blocks.
    side = F.when(F.col("own") == F.col("other"), -1).otherwise((F.col("own") > F.col("other")).cast("int"))
    keyed = dealt.select("turn", "sketch", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side.alias("side"), "node", "part", "body")
    return keyed.groupBy("turn", "sketch", "i", "j").applyInArrow(lambda t: _links_across(t, least), "a string, b string").distinct()


def near_duplicate_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """``node`` (MD5 of a text), ``class_id``, ``class_size``, ``keeper`` (the class's node that stays) and ``keepers``
    (how many equal rows it has), a row per distinct text. See ``mark_near_duplicates``."""
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("body")).where(F.col("body").isNotNull()).withColumn("node", F.md5("body"))
    # The texts are read once; what follows moves sketches and ids, and no aggregate carries more than ids.
    fields = [T.StructField("sketches", T.ArrayType(T.LongType()))]
    sketched = stored(add_columns(rows, lambda: _sketches, ["body"], fields, ["body"]), "text-sketches")
    # Equal texts are one node, so copies, however many, cost one row each and no pair.
    ids = F.struct(F.col("id").isNull().alias("none"), "id", "n")
    of_id = sketched.groupBy("node", "id").agg(F.count("*").alias("n"))
    nodes = stored(of_id.groupBy("node").agg(F.min(ids).alias("first"), F.sum("n").alias("rows")), "text-nodes")
    # Of a node's documents the first one speaks for it (if that has equal rows, each does, and nothing changes).
    summaries = sketched.join(nodes.select("node", "first"), "node").where(F.col("id").eqNullSafe(F.col("first.id")))
    buckets = stored(summaries.select(F.posexplode("sketches").alias("turn", "sketch"), "node", "first"), "text-buckets")
    # A bucket's centre is its document with the least id; all others of the bucket are compared with it.
    centres = buckets.groupBy("turn", "sketch").agg(F.min(F.struct("first", "node")).alias("centre"), F.count("*").alias("n")).where("n > 1")
    shared = stored(buckets.select("turn", "sketch", "node").join(centres, ["turn", "sketch"]).select("turn", "sketch", "node", F.col("centre.node").alias("centre")), "shared-sketches")
    pairs = stored(shared.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "sketch-pairs")
    involved = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = stored(rows.select("node", "body").join(involved, "node", "left_semi").groupBy("node").agg(F.first("body").alias("body")), "sketch-texts")
    links = stored(_verified(pairs, texts, least).select("a", "b"), "sketch-links")
    parts = stored(components(links), "sketch-parts")
    # Buckets whose members are not all in one part yet: there, members were compared with the centre alone.
    placed = shared.join(parts, "node", "left").select("turn", "sketch", "node", F.coalesce("root", "node").alias("part"))
    mixed = placed.groupBy("turn", "sketch").agg(F.min("part").alias("p"), F.max("part").alias("q"), F.count("*").alias("n")).where("p <> q and n > 2").select("turn", "sketch")
    members = placed.join(mixed, ["turn", "sketch"], "left_semi").distinct()
    more = stored(_rest_links(stored(members, "rest-members").join(texts, "node"), least), "rest-links")
    known = parts.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))
    final = components(known.unionByName(more)) if not more.isEmpty() else parts
    joined = stored(nodes.join(final, "node", "left").withColumn("root", F.coalesce("root", "node")), "text-classes")
    each = joined.groupBy("root").agg(F.min(F.struct("first", "node")).alias("best"), F.sum("rows").alias("class_size"))
    return joined.join(each, "root").select("node", F.col("best.first.id").alias("class_id"), "class_size", F.col("best.node").alias("keeper"), F.col("best.first.n").alias("keepers"))


def mark_near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """Add ``class_id`` (least id of the document's class), ``class_size`` and ``kept`` (one document of each class).

    Texts are compared by runs of five lower-cased words. A sketch takes the few labelled runs of
    least hash and keeps their order in the text, so it feels moved passages as well as changed ones.
    Equal texts are one node. Texts that share a sketch are candidates; in each bucket all are
    compared with the one of least id. Where that leaves a bucket in several parts, its members are
    compared across parts by an exact bound, block by block inside the tasks, so no link between
    candidates is lost, and texts that merely share a passage emit no pairs. Every candidate pair is verified by banded
    alignment of its runs: aligned runs over all runs, at least ``least``. Classes are the connected
    components of the links.

    A null text is a class of its own. Equal texts, empty ones too, are one class; a text without
    words is like no other one. Ids may repeat or be null: a class of null ids has a null
    ``class_id``. Of equal rows that could all stay, ``kept`` marks each one, and ``keep_one`` drops
    the others. Empty table: no rows. Columns with the added names are replaced, all others kept.
    """
    added = ["class_id", "class_size", "kept"]
    marked, names = _with_classes(docs, doc_id, text, least)
    return marked.select(*[f"`{c}`" for c in without(docs, added).columns], *[F.col(names[c]).alias(c) for c in added])


def _with_classes(docs: DataFrame, doc_id: str, text: str, least: float) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with what was found of each, under names that ``docs`` doesn't hold."""
    classes = stored(near_duplicate_classes(docs, doc_id, text, least), "classes").alias("c")
    names = {c: unused(f"_{c}", docs.columns) for c in ("node", "class_id", "class_size", "kept", "keepers")}
    rows = docs.withColumn(names["node"], F.md5(F.col(f"`{text}`").cast("string"))).alias("d")
    node, own_id = F.col(f"d.{names['node']}"), F.col(f"d.`{doc_id}`")
    stays = node.isNull() | (node == F.col("c.keeper")) & F.col("c.class_id").eqNullSafe(own_id)
    found = {
        "class_id": F.when(node.isNull(), own_id).otherwise(F.col("c.class_id")),
        "class_size": F.when(node.isNull(), 1).otherwise(F.col("c.class_size")),
        "kept": stays, "keepers": F.col("c.keepers"), "node": node,
    }
    joined = rows.join(classes, node == F.col("c.node"), "left")
    return joined.select(*[F.col(f"d.`{c}`") for c in docs.columns], *[value.alias(names[c]) for c, value in found.items()]), names


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One document of each class, with the columns of ``docs``."""
    marked, names = _with_classes(docs, doc_id, text, least)
    kept = marked.where(F.col(names["kept"]))
    once = kept.where(F.col(names["node"]).isNull() | (F.col(names["keepers"]) == 1))
    repeated = kept.where(F.col(names["keepers"]) > 1).dropDuplicates([names["node"]])
    return once.unionByName(repeated).select(*[F.col(f"`{c}`") for c in docs.columns])
