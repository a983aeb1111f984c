"""Near-duplicate vectors: rotated, split into low-dimensional blocks, range-joined per block, verified by cosine."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rackwise.llm.common import add_columns, any_names, stored, without
from rackwise.llm.components import components

BLOCK, KEYED, LEAST = 8, 3, 0.98
HOME_ROWS, PROBE_ROWS = 2000, 20_000
_SLACK = 1e-9


def usable(vector: list | None) -> np.ndarray | None:
    """The vector in double precision, scaled by a power of two so that its largest entry is near 1 (cosines stay the same);
    None if it is null, empty or zero, or holds a null or non-finite number."""
    if not vector or None in vector:
        return None
    x = np.array(vector, float)
    largest = np.abs(x).max()
    return np.ldexp(x, -int(np.frexp(largest)[1])) if 0 < largest < np.inf else None


@cache
def rotation(dim: int, seed: int = 3) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng((seed, dim)).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def blocks_of(dim: int, block: int = BLOCK) -> list[tuple[int, int]]:
    return [(at, min(dim, at + block)) for at in range(0, dim, block)]


def _placed(least: float) -> object:
    """Rows of every block: the vector's own cell, and the cells that its range touches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label = batch.column("number").to_numpy(), batch.column("label").to_numpy(zero_copy_only=False)
            lists = batch.column("vector").to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(lists):
                by_dim.setdefault(len(v), []).append(i)
            for dim, rows in by_dim.items():
                x = np.array([lists[i] for i in rows], float)
                x = x / np.linalg.norm(x, axis=1, keepdims=True) @ rotation(dim)
                for b, (start, stop) in enumerate(blocks_of(dim)):
                    part = x[:, start:stop]
                    reach = np.sqrt((2 - 2 * least) * (stop - start) / dim) + _SLACK
                    keys = part[:, :KEYED]
                    side = 2 * reach
                    home = np.floor(keys / side).astype(np.int64)
                    low, high = np.floor((keys - reach) / side).astype(np.int64), np.floor((keys + reach) / side).astype(np.int64)
                    points = pa.array(list(part), pa.list_(pa.float64()))
                    yield _cells(node[rows], label[rows], dim, b, home, points, True)
                    for corner in product((False, True), repeat=keys.shape[1]):
                        up = np.array(corner)
                        fits = ~(up & (low == high)).any(axis=1)
                        if fits.any():
                            chosen = np.flatnonzero(fits)
                            cells = np.where(up, high, low)[chosen]
                            yield _cells(node[rows][chosen], label[rows][chosen], dim, b, cells, points.take(pa.array(chosen)), False)

    return run


def _cells(node: np.ndarray, label: np.ndarray, dim: int, block: int, cells: np.ndarray, points: pa.Array, home: bool) -> pa.RecordBatch:
    n = len(node)
    place = pa.array([f"{dim}:{block}:{','.join(map(str, c))}" for c in cells.tolist()])
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(label), place, points, pa.array(np.full(n, home))], ["number", "label", "place", "point", "home"])


def _near(table: pa.Table, least: float) -> pa.Table:
    """Pairs of one cell within the block's range: own against touching rows, each pair once."""
    home = table["home"].to_numpy()
    node = table["number"].to_numpy()
    points = np.array(table["point"].to_pylist(), float).reshape(len(node), -1)
    dim = int(table["place"][0].as_py().split(":")[0])
    most = ((2 - 2 * least) * points.shape[1] / dim) + 2 * _SLACK
    a, b = np.flatnonzero(home), np.flatnonzero(~home)
    found_a, found_b = [], []
    squares = (points[b] ** 2).sum(axis=1)
    for at in range(0, len(a), 256):
        rows = a[at:at + 256]
        gap = (points[rows] ** 2).sum(axis=1)[:, None] + squares - 2 * points[rows] @ points[b].T
        i, j = np.nonzero((gap <= most) & (node[rows][:, None] < node[b]))
        found_a.append(node[rows][i])
        found_b.append(node[b][j])
    left, right = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (found_a, found_b))
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _candidates(nodes: DataFrame, least: float) -> DataFrame:
    shape = "number long, label long, place string, point array<double>, home boolean"
    rows = nodes.select("number", F.xxhash64("label").alias("label"), "vector").mapInArrow(_placed(least), shape)
    rows = stored(rows, "vector-cells")
    # Splits of a cell: so many for its own rows times so many for the touching ones; one for most.
    counts = rows.groupBy("label", "place").agg(F.sum(F.col("home").cast("int")).alias("h"), F.sum((~F.col("home")).cast("int")).alias("p")).where("h > 0 and p > 1")
    splits = counts.select("label", "place", F.ceil(F.col("h") / HOME_ROWS).cast("int").alias("hs"), F.ceil(F.col("p") / PROBE_ROWS).cast("int").alias("ps"))
    own = F.pmod(F.xxhash64("number", "home"), F.when(F.col("home"), F.col("hs")).otherwise(F.col("ps"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("home"), F.col("ps")).otherwise(F.col("hs")) - 1))
    dealt = rows.join(stored(splits, "vector-splits"), ["label", "place"]).withColumn("own", own).withColumn("other", other)
    dealt = dealt.withColumn("i", F.when(F.col("home"), F.col("own")).otherwise(F.col("other"))).withColumn("j", F.when(F.col("home"), F.col("other")).otherwise(F.col("own")))
    keyed = dealt.select("label", "place", "i", "j", "number", "point", "home")
    return keyed.groupBy("label", "place", "i", "j").applyInArrow(lambda t: _near(t, least), "a long, b long").distinct()


@any_names("vec_id", "vector", "label")
def link_vectors(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = LEAST) -> DataFrame:
    """Add ``n_links``, ``component_id`` and ``kept`` to every row.

    Rows with equal, not null labels are linked if their cosine in double precision is at least
    ``least``. Equal vectors of a label are one node. Unit vectors that near lie within a squared
    distance of ``2 - 2 * least``; a rotation that is the same for all spreads it evenly, and when
    the vectors are cut into blocks, in one block at least the pair stays within that block's share
    (its part of the dimensions) of the squared distance. Each block is range-joined: a grid over its
    first dimensions, where each vector stands in its own cell and in all cells its range touches.
    Crowded cells are split into many tasks. The union of the blocks' pairs is verified exactly.

    ``n_links`` counts the other rows linked directly, ``component_id`` is the least id that links
    reach, the row's own id included, ``kept`` tells whether that is the row's id. Null vectors and
    labels, zero vectors and vectors that hold a null or a non-finite number link with nothing;
    vectors of different lengths have no cosine. Repeated rows are rows of their own. Empty table: no
    rows. Columns with the added names are replaced, all others kept.
    """
    added = ["n_links", "component_id", "kept"]

    def keys(vectors: list) -> list:
        scaled = [usable(v) for v in vectors]
        named = [None if x is None else blake2b(np.array(v, float).tobytes(), digest_size=16).hexdigest() for x, v in zip(scaled, vectors, strict=True)]
        return [named, scaled]

    kept = without(rows, added)
    marked = kept.withColumn("_vector", F.col(vector).cast("array<double>"))
    fields = [T.StructField("_key", T.StringType()), T.StructField("_scaled", T.ArrayType(T.DoubleType()))]
    marked = add_columns(marked, lambda: keys, ["_vector"], fields, ["_vector"])
    node = F.when(F.col("_key").isNotNull() & F.col(label).isNotNull(), F.concat_ws(":", "_key", F.col(label).cast("string")))
    marked = marked.withColumn("_node", node)
    nodes = stored(
        marked.where("_node is not null").select("_node", F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col("_scaled").alias("vector"))
        .groupBy("_node").agg(F.count("*").alias("copies"), F.min("id").alias("first_id"), F.first("label").alias("label"), F.first("vector").alias("vector"))
        .withColumn("number", F.xxhash64("_node")), "vectors")
    pairs = stored(_candidates(nodes, least), "vector-pairs")
    one = nodes.select(F.col("number").alias("a"), F.col("_node").alias("node_a"), F.col("label").alias("label_a"), F.col("vector").alias("x"))
    two = nodes.select(F.col("number").alias("b"), F.col("_node").alias("node_b"), F.col("label").alias("label_b"), F.col("vector").alias("y"))

    def cosines(xs: list, ys: list) -> list:
        out = []
        for x, y in zip(xs, ys, strict=True):
            x, y = np.array(x), np.array(y)
            out.append(float(x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y))) if len(x) == len(y) else None)
        return [out]

    both = pairs.join(one, "a").join(two, "b").where("label_a = label_b").select("node_a", "node_b", "x", "y")
    judged = add_columns(both, lambda: cosines, ["x", "y"], [T.StructField("cosine", T.DoubleType())], ["x", "y"])
    links = stored(judged.where(F.col("cosine") >= least).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct(), "vector-links")
    ends = links.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
    sizes = nodes.select("_node", "copies", "first_id")
    neighbours = ends.join(sizes.withColumnRenamed("_node", "other"), "other").groupBy("node").agg(F.sum("copies").alias("near"))
    parts = components(links).join(sizes.withColumnRenamed("_node", "node"), "node")
    least_ids = parts.groupBy("root").agg(F.min("first_id").alias("least_id"))
    facts = (
        sizes.join(neighbours.withColumnRenamed("node", "_node"), "_node", "left")
        .join(parts.select(F.col("node").alias("_node"), "root").join(least_ids, "root").drop("root"), "_node", "left")
        .select("_node", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("_links"), F.coalesce("least_id", "first_id").alias("_least"))
    )
    joined = marked.drop("_scaled", "_key").join(stored(facts, "vector-facts"), "_node", "left")
    root = F.when(F.col("_node").isNull(), F.col(vec_id)).otherwise(F.col("_least"))
    return (
        joined.withColumn("n_links", F.coalesce("_links", F.lit(0)).cast("long")).withColumn("component_id", root.cast("long"))
        .withColumn("kept", F.col(vec_id).eqNullSafe(F.col("component_id"))).select(*kept.columns, *added)
    )
