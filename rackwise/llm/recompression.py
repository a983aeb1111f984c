"""Removal of long passages that an earlier document holds already, found by recompression.

Words, then runs of one word, then pairs of neighbours get global names, round by round. Which two
neighbours become a pair depends on their names alone, so in equal passages all but a few symbols at
either end get the same names. Every window of words thus has symbols of its own that any text with
that window shares; the longest of them stands for the window. Windows whose symbol only one document
has can't repeat; the others are compared by a digest of all their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rackwise.llm.common import SLICE_ROWS, mapped, stored, unused, without

WINDOW, ROUNDS = 13, 3
PIECE_WORDS, PIECE_BYTES, ROWS_FOLDED = 1 << 17, 1 << 19, 1 << 18
# A filter of names goes to every task: 16 bits a name, at most 64 MB. A fuller one lets more windows through
# to the comparison, and loses none.
BITS_A_NAME, MOST_BITS, LEAST_BITS = 16, 1 << 29, 1 << 16
ADDED = ["n_words", "n_removed", "kept_text", "kept_sha256"]
_LAST_ID = (1 << 63) - 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_M1, _M2, _SHIFT = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _M1
    x = (x ^ (x >> _SHIFT)) * _M2
    return x ^ (x >> _SHIFT)


@cache
def _powers(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, b, np.uint64)])) for b in (base, inverse))


def _hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit name of every word of ``text``, and the byte where it starts."""
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~_SPACE[data]
    starts, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:])
    reach = max(2 * PIECE_BYTES, 1 << len(data).bit_length())
    name = mixed((ends - starts).astype(np.uint64) + _BASES[0])
    for k, base in enumerate(_BASES):
        up, down = _powers(base, reach)
        letters = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1000 * k + 1))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(letters[data] * up[:len(data)], out=sums[1:])
        name = mixed(name + (sums[ends + 1] - sums[starts]) * down[starts])
    return name, starts


def word_names(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The names of all words of all texts, end to end, and how many each text has."""
    sizes = np.array([len(t or b"") + 1 for t in texts], np.int64)
    whole = b" ".join(t or b"" for t in texts)
    text_starts = np.cumsum(sizes) - sizes
    names, places, at = [], [], 0
    while at < len(whole):
        end = at + PIECE_BYTES
        while end < len(whole) and not _SPACE[whole[end]]:
            end += 1
        found, starts = _hashed(whole[at:end])
        names.append(found)
        places.append(starts + at)
        at = end
    if not names:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    owner = np.searchsorted(text_starts, np.concatenate(places), "right") - 1
    return np.concatenate(names), np.bincount(owner, minlength=len(texts))


def window_keys(words: np.ndarray, starts: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Two digests, of 64 and of 32 bits, of the windows of ``words`` that start at ``starts``."""
    key, check = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64)
    for k in range(size):
        word = words[starts + k]
        key = key * _BASES[0] + word
        check = (check ^ (word >> _SHIFT) ^ (word << np.uint64(7))) * _M2
    return mixed(key), mixed(check) >> np.uint64(32)


def _largest(score: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    best = score[first]
    for k in range(1, int((last - first).max(initial=0)) + 1):
        best = np.maximum(best, score[np.minimum(first + k, last)])
    return best


def _scores(names: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Longer symbols first; among equally long ones, one picked by its name."""
    return np.minimum(length, 255).astype(np.uint64) << np.uint64(56) | mixed(names) >> np.uint64(8)


def window_symbols(words: np.ndarray, size: int = WINDOW, rounds: int = ROUNDS) -> np.ndarray:
    """Of each window of ``size`` words a name that every occurrence of the window gives, whatever is around it.

    ``first`` and ``last`` are the window's symbols whose names its own words settle. The outermost runs
    may go on outside, so they are left; a symbol that may be the second of a pair is left at the
    start, one that may be the first of a pair at the end. A window's name is that of its longest
    symbol in the last round that leaves it one; a window of one or two runs is named by all its words.
    """
    n = max(0, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    if not n:
        return out
    starts = np.flatnonzero(np.concatenate([[True], words[1:] != words[:-1]]))
    place = np.zeros(len(words), np.int64)
    place[starts[1:]] = 1
    place = np.cumsum(place)
    length = np.diff(np.append(starts, len(words)))
    names = words[starts]
    names = np.where(length > 1, mixed(names + length.astype(np.uint64) * _M1), names)
    first, last = place[:n] + 1, place[size - 1:] - 1
    flat = np.flatnonzero(first > last)
    out[flat] = window_keys(words, flat, size)[0]
    left = np.flatnonzero(first <= last)
    first, last = first[left], last[left]
    for r in range(rounds):
        second = mixed(names + np.uint64((r + 1) * int(_M2) % (1 << 64))) >> np.uint64(63) == 1
        joins = np.zeros(len(names), bool)
        joins[1:] = second[1:] & ~second[:-1]
        starts = np.flatnonzero(~joins)
        place = np.cumsum(~joins) - 1
        pairs = np.flatnonzero(np.append(joins[1:], False)[starts])
        new = names[starts]
        new[pairs] = mixed(mixed(new[pairs]) + names[starts[pairs] + 1])
        new_first, new_last = place[first] + second[first], place[last] - ~second[last]
        gone = new_first > new_last
        if gone.any():
            out[left[gone]] = _largest(_scores(names, length), first[gone], last[gone])
            left, new_first, new_last = left[~gone], new_first[~gone], new_last[~gone]
        first, last = new_first, new_last
        names, length = new, np.add.reduceat(length, starts)
    out[left] = _largest(_scores(names, length), first, last)
    return out


def _pieces(words: np.ndarray, counts: np.ndarray, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Bounded stretches of words, each with its place and the starts of those windows that lie in one text."""
    owner = np.repeat(np.arange(len(counts)), counts)
    for at in range(0, max(0, len(words) - size + 1), PIECE_WORDS):
        part = words[at:at + PIECE_WORDS + size - 1]
        n = len(part) - size + 1
        starts = np.flatnonzero(owner[at:at + n] == owner[at + size - 1:at + size - 1 + n])
        if len(starts):
            yield at, part, starts


def _extremes(names: list[str], columns: list[np.ndarray], ids: np.ndarray) -> pa.RecordBatch:
    """Of each different row of ``columns`` its least and its greatest id, as one row or two."""
    order = np.lexsort((ids, *columns[::-1]))
    ordered, ids = [c[order] for c in columns], ids[order]
    changes = np.zeros(max(0, len(ids) - 1), bool)
    for c in ordered:
        changes |= c[1:] != c[:-1]
    first, last = np.append(True, changes)[:len(ids)], np.append(changes, True)[:len(ids)]
    heads = np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
    keep = first | last & (ids != ids[heads])
    return pa.RecordBatch.from_arrays([*[pa.array(c[keep].view(np.int64)) for c in ordered], pa.array(ids[keep])], [*names, "doc"])


class NameFilter:
    """A set of 64-bit names, possibly too large by some others: two bits of a bounded map for each name."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def __contains__(self, name: int) -> bool:
        return bool(self.holds(np.array([name]))[0])

    def holds(self, names: np.ndarray) -> np.ndarray:
        x, mask = names.view(np.uint64), np.uint64(len(self.bits) * 8 - 1)
        found = np.ones(len(x), bool)
        for place in (x & mask, x >> np.uint64(32) & mask):
            found &= self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1
        return found


def name_filter(names: DataFrame, name: str, n: int) -> NameFilter:
    """The filter of a column of ``n`` names, put together by Spark as bitmaps of 4 KB."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * BITS_A_NAME).bit_length()))
    places = F.array(F.col(name).bitwiseAND(bits - 1), F.shiftrightunsigned(F.col(name), 32).bitwiseAND(bits - 1))
    each = names.select(F.explode(places).alias("place")).select((F.col("place") + 1).alias("place"))
    maps = each.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    size = 1 << 12
    for row in maps.toArrow().to_pylist():
        out[(row["bucket"] - 1) * size:row["bucket"] * size] = np.frombuffer(row["map"], np.uint8)
    return NameFilter(out)


def _slices(batches: Iterator[pa.RecordBatch], may_repeat) -> Iterator[pa.RecordBatch]:
    """Some rows at a time, without texts that ``may_repeat`` as a whole."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            some = batch.slice(at, SLICE_ROWS)
            yield some if may_repeat is None else some.filter(pa.array(~may_repeat.value.holds(some.column(2).to_numpy())))


def _folded(parts: Iterator[tuple[np.ndarray, ...]], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The extremes of about ``ROWS_FOLDED`` rows at a time; the last column of ``parts`` is the id."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[-1])
        if size >= ROWS_FOLDED:
            yield _extremes(names, *_joined(held))
            held, size = [], 0
    if size:
        yield _extremes(names, *_joined(held))


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[list[np.ndarray], np.ndarray]:
    *columns, ids = (np.concatenate(c) for c in zip(*parts, strict=True))
    return columns, ids


def _windows_of(batches: Iterator[pa.RecordBatch], size: int, may_repeat) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Stretches of words, the starts of their windows, and the windows' document ids."""
    for some in _slices(batches, may_repeat):
        words, counts = word_names(some.column(1).to_pylist())
        owner = np.repeat(some.column(0).to_numpy(), counts)
        for at, part, starts in _pieces(words, counts, size):
            yield part, starts, owner[at + starts]


def _symbol_rows(size: int, rounds: int, may_repeat):
    def symbols(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for part, starts, of in _windows_of(batches, size, may_repeat):
            symbol = window_symbols(part, size, rounds)[starts]
            new = np.ones(len(symbol), bool)
            new[1:] = (symbol[1:] != symbol[:-1]) | (of[1:] != of[:-1])
            yield symbol[new], of[new]

    return lambda batches: _folded(symbols(batches), ["name"])


def _window_rows(size: int, rounds: int, may_repeat, shared):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for part, starts, of in _windows_of(batches, size, may_repeat):
            keep = shared.value.holds(window_symbols(part, size, rounds)[starts])
            yield *window_keys(part, starts[keep], size), of[keep]

    return lambda batches: _folded(windows(batches), ["key", "check"])


def _hits(texts: list[bytes | None], size: int, repeats: NameFilter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows that may repeat: key, check, text, place in the text; and the texts' numbers of words."""
    words, counts = word_names(texts)
    owner, text_starts = np.repeat(np.arange(len(texts)), counts), np.cumsum(counts) - counts
    found = []
    for at, part, starts in _pieces(words, counts, size):
        key, check = window_keys(part, starts, size)
        keep = repeats.holds(key)
        of = owner[at + starts[keep]]
        found.append((key[keep], check[keep], of, at + starts[keep] - text_starts[of]))
    empty = np.zeros(0, np.int64)
    columns = [np.concatenate([f[k] for f in found]) if found else empty for k in range(4)]
    return *[c.view(np.int64) for c in columns], counts


def _hit_rows(size: int, may_repeat, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _slices(batches, may_repeat):
            key, check, of, place, _ = _hits(some.column(1).to_pylist(), size, shared.value)
            ids, texts = some.column(0).to_numpy(), some.column(2).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key, check, ids[of], texts[of], place.astype(np.int32))], ["key", "check", "doc", "hash", "place"])

    return run


def covered(places: np.ndarray, n_words: int, size: int) -> np.ndarray:
    """Which of ``n_words`` words the windows at ``places`` cover."""
    steps = np.bincount(places, minlength=n_words + 1) - np.bincount(places + size, minlength=n_words + 1)[:n_words + 1]
    return np.cumsum(steps)[:n_words] > 0


def _whole_copies(docs: DataFrame):
    """Later copies of whole texts (``doc``, ``hash``), the first document of each text that may have copies, and the
    filter of such texts.

    Ids and digests alone find the texts that repeat. Only texts that the filter names are then joined
    with them, so the others are not moved.
    """
    again = F.xxhash64(F.lit(1), "text")
    texts = docs.select("doc", "hash", again.alias("again")).groupBy("hash", "again").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    texts = stored(texts.where("low < high").select("hash", "again", "low"), "repeated-texts")
    may_repeat = docs.sparkSession.sparkContext.broadcast(name_filter(texts, "hash", texts.count()))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_repeat.value.holds(batch.column(2).to_numpy())))

    some = docs.select("doc", "text", "hash").mapInArrow(named, "doc long, text binary, hash long").withColumn("again", again)
    placed = stored(some.join(texts, ["hash", "again"], "left").select("doc", "text", "hash", (F.col("doc") > F.col("low")).alias("later")), "texts-that-may-repeat")
    later = F.coalesce("later", F.lit(False))
    return placed.where(later).select("doc", "hash").distinct(), placed.where(~later).select("doc", "text", "hash"), may_repeat


def repeated_windows(docs: DataFrame, size: int, rounds: int):
    """Of ``docs`` (``doc``, ``text`` as bytes, ``hash``): ``doc``, ``hash``, whether the whole text is a later ``copy``, and if it is
    not, ``places``, the windows that also start in a document of smaller id, in no order; and the
    filter of window keys that two documents share."""
    context = docs.sparkSession.sparkContext
    copies, firsts, may_repeat = _whole_copies(docs)
    ends = [F.min("doc").alias("low"), F.max("doc").alias("high")]

    def scanned(rows, schema: str) -> DataFrame:
        """The rows of all texts but later copies: they hold no window that their first document doesn't."""
        alone = docs.select("doc", "text", "hash").mapInArrow(rows(may_repeat), schema)
        return alone.unionByName(firsts.mapInArrow(rows(None), schema))

    symbols = scanned(lambda skip: _symbol_rows(size, rounds, skip), "name long, doc long").groupBy("name").agg(*ends).where("low < high")
    symbols = stored(symbols.select("name"), "shared-symbols")
    of_symbols = context.broadcast(name_filter(symbols, "name", symbols.count()))
    windows = scanned(lambda skip: _window_rows(size, rounds, skip, of_symbols), "key long, check long, doc long").groupBy("key", "check").agg(*ends)
    windows = stored(windows.where("low < high").select("key", "check", "low"), "shared-windows")
    of_windows = context.broadcast(name_filter(windows, "key", windows.count()))
    hits = scanned(lambda skip: _hit_rows(size, skip, of_windows), "key long, check long, doc long, hash long, place int")
    later = hits.join(windows, ["key", "check"]).where("doc > low").select("doc", "hash", "place")
    found = later.groupBy("doc", "hash").agg(F.collect_list("place").alias("places"))
    return found.withColumn("copy", F.lit(False)).unionByName(copies.withColumns({"places": F.lit(None).cast("array<int>"), "copy": F.lit(True)})), of_windows


def remove_repeats(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW, rounds: int = ROUNDS, digest: bool = False
) -> DataFrame:
    """Add ``n_words``, ``n_removed`` and ``kept_text``: the words, joined by one space, that no repeated window covers.

    Words are runs of anything but ASCII white space. A window is ``size`` consecutive words of one
    document; it is repeated if the same words also stand in a row in a document of smaller id,
    whatever is removed there. With ``digest`` the SHA-256 of the kept text (``kept_sha256``) comes in its
    place, and only texts that may hold a repeat are moved between machines.

    Later copies of a whole text are told by its digest and removed as a whole; the steps below pass over them.
    Symbols, then windows, are folded to their least and greatest id in each task before the shuffle, so a
    passage in any share of all documents is one row per task; their later occurrences meet the
    least id in a join that Spark can split. A null text has no words. A document without an id counts as
    later than all others, and two of the same id are not earlier than each other: equal rows get
    equal results. Texts of fewer words than ``size`` stay whole; very long ones go through in stretches.
    Ids must be whole numbers. Empty table: no rows. Columns named as the added ones are replaced, all
    others kept, but for the text with ``digest``.
    """
    kept = without(docs, [c for c in ADDED if c.lower() not in (text.lower(), doc_id.lower())])
    names = kept.columns
    doc, body, digest_of, places, copy = (unused(c, names) for c in ("_doc", "_body", "_hash", "_places", "_copy"))
    as_text = F.col(f"`{text}`").cast("string")
    rows = kept.withColumns({doc: F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(_LAST_ID)), body: as_text.cast("binary"), digest_of: F.xxhash64(as_text)})
    repeated, of_windows = repeated_windows(rows.select(F.col(doc).alias("doc"), F.col(body).alias("text"), F.col(digest_of).alias("hash")), size, rounds)
    if digest:
        rows = rows.drop(text)
        names = [c for c in names if c != text]
        rows = _digested(rows, body, size, of_windows)
    found = repeated.alias("r")
    joined = rows.alias("d").join(found, (F.col(f"d.{doc}") == F.col("r.doc")) & (F.col(f"d.{digest_of}") == F.col("r.hash")), "left")
    carried = [f"d.`{c}`" for c in (*names, body)] + (["d.n_words", "d.kept_sha256"] if digest else [])
    return _without_repeats(joined.select(*carried, F.col("r.places").alias(places), F.col("r.copy").alias(copy)), names, size, digest)


def _digested(rows: DataFrame, body: str, size: int, of_windows) -> DataFrame:
    """Add ``n_words`` and, where no window may repeat, ``kept_sha256`` in place of the text."""
    fields = rows.schema.fields
    place = [f.name for f in fields].index(body)
    result = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("kept_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, None):
            texts = batch.column(place).to_pylist()
            _, _, of, _, counts = _hits(texts, size, of_windows.value)
            may = np.bincount(of, minlength=len(texts)) > 0
            digests = [None if m else _sha((t or b"").split()) for t, m in zip(texts, may.tolist(), strict=True)]
            columns = list(batch.columns)
            columns[place] = pa.array([t if m else None for t, m in zip(texts, may.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pa.array(digests, pa.string())], result.names)

    return mapped(rows, run, result)


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _without_repeats(joined: DataFrame, names: list[str], size: int, digest: bool) -> DataFrame:
    n = len(names)
    last = T.StructField("kept_sha256", T.StringType()) if digest else T.StructField("kept_text", T.BinaryType())
    result = T.StructType([*joined.schema.fields[:n], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), last])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, places, copies = batch.column(n), batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_pylist()
            counts, removed, out = [], [], []
            for k in range(batch.num_rows):
                known = batch.column(n + 2)[k].as_py() if digest else None
                words = (texts[k].as_py() or b"").split() if known is None else []
                counts.append(len(words) if known is None else batch.column(n + 1)[k].as_py())
                if copies[k] and counts[-1] >= size:
                    removed.append(counts[-1])
                    words, known = [], None
                elif places[k].is_valid:
                    gone = covered(places[k].values.to_numpy(), len(words), size)
                    removed.append(int(gone.sum()))
                    words = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                else:
                    removed.append(0)
                out.append((known or _sha(words)) if digest else b" ".join(words))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string() if digest else pa.binary())], result.names)

    done = mapped(joined, run, result)
    return done if digest else done.withColumn("kept_text", F.col("kept_text").cast("string"))
