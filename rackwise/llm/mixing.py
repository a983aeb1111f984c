"""Mixing sources to target weights: pivotal rounding in groups, residuals combined by a reduction tree."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from rackwise.llm.common import any_names, stored, without
from rackwise.operators.numbering import number_rows

GROUP_DOCS = 2048
TREE_WIDTH = 64
_NEAR = 1e-9
_HASHED = (T.NumericType, T.StringType, T.BooleanType, T.DatetimeType, T.BinaryType)


def word_count(text: Column) -> Column:
    """Runs of characters that are no white space (space, tab to carriage return); null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """``source``, ``source_size``, ``n_docs`` and ``target``, a row per source of ``sizes`` (``source``, ``size``,
    and ``n`` if a row stands for several).

    Sources in order of their code points, null last, take ``weights`` in turn and share ``share``
    times all sizes by them. No target exceeds ``cap`` times its source's size; what is above is
    reshared by weight among the others. Sources fill up in order of size over weight, so one
    ordered pass over the per-source rows finds who is capped. A share above the cap ends with
    every source capped. Empty table: no rows.
    """
    n = F.col("n") if "n" in sizes.columns else F.lit(1)
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * n).alias("source_size"), F.sum(n).cast("long").alias("n_docs"))
    # The windows have no partitions: they see one row per source.
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = per.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    by_fill = Window.orderBy(F.col("source_size") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * share - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    # Words per weight if this source and all that fill up later share what the earlier ones left.
    level = left / F.sum("_w").over(rest)
    leveled = weighed.withColumn("_level", level).withColumn("_full", F.col("_level") * F.col("_w") >= cap * F.col("source_size"))
    # The first source that is not full has the level that holds for all that follow; theirs, taken as if it were full, are lower.
    final = F.max(F.when(~F.col("_full"), F.col("_level"))).over(everything)
    target = F.when(F.col("_full"), cap * F.col("source_size")).otherwise(F.col("_final") * F.col("_w"))
    return leveled.withColumn("_final", final).select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def pivotal(p: np.ndarray, draws: np.ndarray) -> tuple[np.ndarray, int]:
    """Round probabilities in their order. Returns 0, 1 or -1 (the one that stays open) for each, and its index or -1;
    ``p`` of the open one is set to the mass it holds.

    Two fractional probabilities meet; one of them takes all it can of the other's mass, chosen so
    that each keeps its expected value, until one of them is 0 or 1; the other one goes on.
    """
    out = np.full(len(p), -1, np.int8)
    held, mass = -1, 0.0
    for i in range(len(p)):
        q = p[i]
        if q <= _NEAR or q >= 1 - _NEAR:
            out[i] = q > 0.5
            continue
        if held < 0:
            held, mass = i, q
            continue
        total = mass + q
        if total <= 1:
            held_wins = draws[i] < mass / total
            win, lose, settled, mass = (held, i, 0, total) if held_wins else (i, held, 0, total)
        else:
            held_full = draws[i] < (1 - q) / (2 - total)
            win, lose, settled, mass = (i, held, 1, total - 1) if held_full else (held, i, 1, total - 1)
        out[lose] = settled
        held = win
        if mass <= _NEAR or mass >= 1 - _NEAR:
            out[held] = mass > 0.5
            held = -1
    if held >= 0:
        p[held] = mass
    return out, held


def _draws(seed: int, name: object, n: int) -> np.ndarray:
    digest = hashlib.blake2b(f"{seed}:{name}".encode(), digest_size=8).digest()
    return np.random.Generator(np.random.PCG64(int.from_bytes(digest, "big"))).random(n)


def _round(keys: pd.DataFrame, chance: np.ndarray, seed: int, name: object) -> tuple[np.ndarray, np.ndarray, int]:
    """``pivotal`` over the rows in order of ``keys``; results are in the rows' own order."""
    order = keys.sort_values(list(keys.columns), kind="stable", na_position="last").index.to_numpy()
    p = chance[order].astype(float)
    out, held = pivotal(p, _draws(seed, name, len(p)))
    settled, mass = np.empty_like(out), np.empty_like(p)
    settled[order], mass[order] = out, p
    return settled, mass, int(order[held]) if held >= 0 else -1


@any_names("doc_id", "source", "size", "text")
def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", size: str | None = None, text: str = "text",
        weights: Sequence[float] = (3.0, 1.0, 2.0), share: float = 1.5, cap: float = 2.0, seed: int = 17,
        group_docs: int = GROUP_DOCS, tree_width: int = TREE_WIDTH) -> DataFrame:
    """Add ``size``, ``source_size``, ``target``, ``copies`` and ``taken`` (size times copies) to every document.

    ``size`` is the column that holds a document's words; without it they are counted in ``text``.
    A document's expected copies are its source's target over its size: the whole part is given to
    all, the fraction is rounded by pivotal dependent rounding, so that each source's copies, and
    nearly its words, come to their target. Documents of a source are dealt by a hash into groups of
    about ``group_docs`` (a hot source into many), put in order of size, and rounded pair by pair;
    each group leaves at most one open fraction. The open ones meet ``tree_width`` at a time, level
    by level, until one is left per source, which is rounded by its own chance. The decisions go
    back down the tree, and the groups are rounded again with them. All draws come from ``seed`` and
    the group, so reruns agree. Only ids, sources and sizes are grouped; the rows meet the decisions in a join.

    A null text has size 0. A null source is a source, the last one. Null or repeated ids are
    documents of their own: those of one id, source and size are rounded as one row that stands for all of them, and if
    some get a copy more, those of least hash do; equal rows are interchangeable. Sources without words have target 0.
    Empty table: no rows. Columns with the added names are replaced, all others kept.
    """
    count = F.coalesce(F.col(size).cast("long"), F.lit(0)).cast("long") if size else word_count(F.col(text).cast("string"))
    own = without(docs, ["size", "source_size", "target", "copies", "taken"])
    kept = docs.select(count.alias("_size"), F.col(source).cast("string").alias("_source"), F.col(doc_id).cast("string").alias("_id"), *own.columns)
    # What is rounded are ids and sizes; texts only meet the decisions. Rows of one id, source and size are one row with their number.
    same = stored(kept.groupBy("_source", "_id", "_size").agg(F.count("*").alias("_n")), "mix-rows")
    sizes = same.select(F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_n").alias("n"))
    targets = stored(source_targets(sizes, weights, share, cap), "mix-targets")

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    number = F.pmod(F.col("_draw"), F.ceil(F.col("n_docs") / group_docs)).cast("long")
    dealt = (
        same.join(targets.withColumnRenamed("source", "_of"), F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
        .withColumn("_draw", F.xxhash64(F.lit(seed), "_id", "_size"))
        .withColumn("_whole", F.floor(ratio + _NEAR).cast("int"))
        .withColumn("_share", F.greatest(ratio - F.col("_whole"), F.lit(0.0)) * F.col("_n"))
        .withColumn("_sure", F.floor(F.col("_share") + _NEAR).cast("long"))
        .withColumn("_chance", F.greatest(F.col("_share") - F.col("_sure"), F.lit(0.0)))
        .withColumn("_number", number)
        .withColumn("_group", F.concat_ws(":", F.col("_number").cast("string"), F.coalesce(F.concat(F.lit("s"), "_source"), F.lit("n"))))
        .select("_source", "_id", "_size", "_n", "_draw", "_whole", "_sure", "_chance", "_number", "_group", "source_size", "target")
    )
    keys = ["_size", "_draw", "_id"]
    node = T.StructType.fromDDL("source string, number long, name string, chance double, words long")
    arrow_node = to_arrow_schema(node)

    def rounded(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, int]:
        return _round(rows.select(keys).to_pandas(), rows["_chance"].to_numpy(), seed, rows["_group"][0].as_py())

    def open_of(rows: pa.Table) -> pa.Table:
        _, mass, held = rounded(rows)
        if held < 0:
            return arrow_node.empty_table()
        source, number, name, words = (rows[c][held].as_py() for c in ("_source", "_number", "_group", "_size"))
        return pa.Table.from_pylist([{"source": source, "number": number, "name": name, "chance": float(mass[held]), "words": words}], arrow_node)

    leaves = stored(dealt.groupBy("_group").applyInArrow(open_of, node), "mix-open")
    verdicts = _resolve(leaves, targets, seed, tree_width, group_docs)
    decided = dealt.join(verdicts, F.col("_group") == F.col("name"), "left").withColumn("_last", F.coalesce("_last", F.lit(0)))
    # more: how many of the n rows get one copy beyond the whole ones.
    chosen = T.StructType.fromDDL("of_source string, of_id string, of_size long, n long, whole int, more long, source_size long, target double")

    def finish(rows: pa.Table) -> pa.Table:
        settled, _, held = rounded(rows)
        settled = settled.astype(np.int64)
        if held >= 0:
            settled[held] = rows["_last"][held].as_py()
        given = [rows[c] for c in ("_source", "_id", "_size", "_n", "_whole")]
        return pa.table([*given, pa.array(rows["_sure"].to_numpy() + settled), rows["source_size"], rows["target"]], chosen.names)

    copies = stored(decided.groupBy("_group").applyInArrow(finish, chosen), "mix-copies")
    extra = (F.col("more") > 0).cast("int")
    some = (F.col("more") > 0) & (F.col("more") < F.col("n"))
    result = _met(kept, copies.where(~some)).withColumn("_extra", extra)
    if not copies.where(some).isEmpty():
        told = [f.name for f in own.schema.fields if isinstance(f.dataType, _HASHED)]
        rows = _met(kept, copies.where(some)).withColumn("_order", F.xxhash64(F.lit(seed), *told))
        turns = number_rows(rows, ["_order"], ["of_source", "of_id", "of_size"], "_turn").drop("_order")
        result = result.unionByName(turns.withColumn("_extra", (F.col("_turn") <= F.col("more")).cast("int")).drop("_turn"))
    n_copies = F.col("whole") + F.col("_extra")
    return result.select(*own.columns, F.col("_size").alias("size"), "source_size", "target", n_copies.alias("copies"), (F.col("_size") * n_copies).alias("taken"))


def _met(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """``rows`` with what was decided for their source, id and size."""
    return rows.join(copies, F.col("_source").eqNullSafe(F.col("of_source")) & F.col("_id").eqNullSafe(F.col("of_id")) & (F.col("_size") == F.col("of_size")))


def _resolve(leaves: DataFrame, targets: DataFrame, seed: int, width: int, group_docs: int) -> DataFrame:
    """0 or 1 (``_last``) for the open fraction of every group (``name``)."""
    most = targets.agg(F.max(F.ceil(F.col("n_docs") / group_docs))).first()[0] or 1
    levels, level, depth = [], leaves, 0
    while most > 1:
        depth += 1
        parent = F.concat_ws(":", F.lit(f"up{depth}"), F.floor(F.col("number") / width).cast("string"), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")))

        def combine(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.reset_index(drop=True)
            settled, mass, _ = _round(rows[["words", "name"]], rows["chance"].to_numpy(), seed, rows["parent"].iat[0])
            return rows.assign(chance=mass, settled=settled.astype(np.int32))

        shape = "source string, number long, name string, chance double, words long, parent string, settled int"
        settled = stored(level.withColumn("parent", parent).groupBy("parent").applyInPandas(combine, shape), f"mix-level{depth}")
        levels.append(settled)
        level = settled.where("settled < 0").select("source", F.floor(F.col("number") / width).cast("long").alias("number"), F.col("parent").alias("name"), "chance", "words")
        most = -(-most // width)
    chance = F.pmod(F.xxhash64(F.lit(seed), F.lit("top"), "name"), F.lit(1 << 30)) / float(1 << 30)
    known = level.select("name", (chance < F.col("chance")).cast("int").alias("_last"))
    for settled in reversed(levels):
        above = known.select(F.col("name").alias("parent"), F.col("_last").alias("_above"))
        known = settled.join(above, "parent", "left").select(
            "name", F.when(F.col("settled") < 0, F.col("_above")).otherwise(F.col("settled")).alias("_last"))
    return stored(known, "mix-last")
