"""Benchmark passages in documents: an FM-index per shard of the documents, searched for the test windows."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rackwise.llm.common import SLICE_ROWS, add_columns, any_names, mapped, stored, without
from rackwise.llm.recompression import NameFilter, name_filter, word_names
from rackwise.sources.workspace import new_folder

WINDOW = 10
BLOCK_BYTES = 4 << 20
SHARD_WORDS = 1 << 18
SLICE_BYTES = 4 << 20
# Fixed value: words are runs of digits, letters and all beyond ASCII; A-Z count as a-z, all else becomes a space.
_SPACED = bytes(b | 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_FOUND = "a long, b long, window long, first int, last int, start int, stop int"


class RankBits:
    """A bit vector that counts its ones before any position: 64-bit words and their running counts."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.zeros(len(bits) // 64 + 1, np.uint64)
        raw = np.packbits(bits, bitorder="little")
        packed.view(np.uint8)[:len(raw)] = raw
        self.packed = packed
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(packed).astype(np.int64))])

    def ones(self, at: np.ndarray) -> np.ndarray:
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.packed[block] & mask).astype(np.int64)


class WaveletTree:
    """Ranks of integer symbols: level by level, the sequence sorted stably by its higher bits, with one bit each."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels, self.zeros = [], []
        now = symbols
        for level in range(self.depth - 1, -1, -1):
            bits = (now >> level & 1).astype(bool)
            self.levels.append(RankBits(bits))
            self.zeros.append(int(len(bits) - bits.sum()))
            now = np.concatenate([now[~bits], now[bits]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before ``at``; both are arrays."""
        low, high = np.zeros_like(at), at.copy()
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.depth - 1 - k) & 1).astype(bool)
            low_ones, high_ones = bits.ones(low), bits.ones(high)
            low = np.where(one, zeros + low_ones, low - low_ones)
            high = np.where(one, zeros + high_ones, high - high_ones)
        return high - low


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order, by doubling; only suffixes that still tie are sorted again.

    Symbol 0 stands for separators: each is unlike every other, in order of position, so ties end at the next one.
    """
    n = len(text)
    zeros = np.flatnonzero(text == 0)
    rank = text.astype(np.int64) + len(zeros) - 1
    rank[zeros] = np.arange(len(zeros))
    order = np.argsort(rank, kind="stable")
    heads = np.concatenate([[True], rank[order[1:]] != rank[order[:-1]]]) if n else np.zeros(0, bool)
    starts = np.flatnonzero(heads)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, n)))
    step = 1
    tied = order[~_alone(heads)]
    while len(tied):
        ahead = tied + step
        second = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        again = np.lexsort((second, rank[tied]))
        tied, first, second = tied[again], rank[tied[again]], second[again]
        new_group = np.concatenate([[True], first[1:] != first[:-1]])
        head = new_group | np.concatenate([[True], second[1:] != second[:-1]])
        group_at = np.flatnonzero(new_group)
        within = np.arange(len(tied)) - np.repeat(group_at, np.diff(np.append(group_at, len(tied))))
        order[first + within] = tied
        head_at = np.flatnonzero(head)
        rank[tied] = np.repeat((first + within)[head_at], np.diff(np.append(head_at, len(tied))))
        tied = tied[~_alone(head)]
        step *= 2
    return order


def _alone(heads: np.ndarray) -> np.ndarray:
    """Where a sorted group has one member."""
    return heads & np.append(heads[1:], True)


class FMIndex:
    """Backward search over a sequence of symbols; 0 separates, and no pattern holds it.

    The suffix of every position that follows a separator is sampled, and of every ``every``-th other one.
    """

    def __init__(self, text: np.ndarray, n_symbols: int, every: int = 4) -> None:
        if not len(text) or text[-1] != 0:
            text = np.append(text, 0)
        order = suffix_order(text)
        self.last = text[order - 1].astype(np.int32)  # the symbol before each suffix; before the first one, the separator at the end
        self.tree = WaveletTree(self.last, n_symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        sampled = (self.last == 0) | (order % every == 0)
        self.sampled = RankBits(sampled)
        self.is_sampled = sampled
        self.positions = order[sampled].astype(np.int32)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of the suffixes that begin with each pattern; a pattern is a row, padded at the right."""
        low = np.zeros(len(patterns), np.int64)
        high = np.full(len(patterns), self.first[-1], np.int64)
        for back in range(1, patterns.shape[1] + 1):
            live = np.flatnonzero((lengths >= back) & (high > low))
            if not len(live):
                continue
            symbol = patterns[live, lengths[live] - back]
            low[live] = self.first[symbol] + self.tree.rank(symbol, low[live])
            high[live] = self.first[symbol] + self.tree.rank(symbol, high[live])
        return low, np.maximum(high, low)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes, by walking back to the next sampled one."""
        rows, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            done = self.is_sampled[rows[open_]]
            found = open_[done]
            out[found] = self.positions[self.sampled.ones(rows[found])] + steps[found]
            open_ = open_[~done]
            at = rows[open_]
            symbol = self.last[at]
            rows[open_] = self.first[symbol] + self.tree.rank(symbol, at)
            steps[open_] += 1
        return out


class Shard(NamedTuple):
    """Indexed words of some texts, and where each stands: its text, number in the text, first character and end."""

    names: np.ndarray  # ascending; symbol k stands for names[k - 1]
    index: FMIndex
    a: np.ndarray  # the texts' keys
    b: np.ndarray
    text: np.ndarray
    number: np.ndarray
    start: np.ndarray
    stop: np.ndarray


def stretches(texts: list[bytes], known: NameFilter, shortest: int) -> list[np.ndarray]:
    """The words worth an index: name, text, number in the text, first character, end.

    A word that ``known`` does not hold separates, and so does the end of a text; separators have the name 0.
    Stretches between separators that are shorter than the shortest pattern can hold no occurrence and are left out.
    """
    folded = [t.translate(_SPACED) for t in texts]
    names, counts = word_names(folded)
    whole = np.frombuffer(b" ".join([*folded, b""]), np.uint8)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (whole != 32).view(np.int8)])))
    characters = np.cumsum((whole & 0xC0) != 0x80, dtype=np.int32) - 1
    begins = characters[np.cumsum([0, *[len(t) + 1 for t in folded[:-1]]])]
    text = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(names)) + text
    line, word = np.zeros(len(names) + len(texts), np.uint64), np.zeros(len(names) + len(texts), np.int64)
    line[place] = np.where(known.holds(names), names, 0)
    word[place] = np.arange(len(names))
    walls = np.flatnonzero(np.concatenate([[True], line == 0]))  # a wall before the first, then after each separator
    at = np.flatnonzero(np.repeat(np.diff(walls) > shortest, np.diff(walls)))
    if not len(at):
        return [np.zeros(0, t) for t in (np.uint64, np.int32, np.int32, np.int32, np.int32)]
    of = word[at]
    number = of - (np.cumsum(counts) - counts)[text[of]]
    start, stop = (characters[edges[k::2][of]] - begins[text[of]] for k in (0, 1))
    return [line[at], *[x.astype(np.int32) for x in (text[of], number, start, stop)]]


def count_words(texts: list[bytes | None]) -> np.ndarray:
    """How many words each text has; none if null."""
    whole = np.frombuffer(b" ".join([b"", *[t or b"" for t in texts]]).translate(_SPACED), np.uint8)
    starts = np.flatnonzero((whole[1:] != 32) & (whole[:-1] == 32))
    text_starts = np.cumsum([0, *[len(t or b"") + 1 for t in texts[:-1]]])
    return np.bincount(np.searchsorted(text_starts, starts, "right") - 1, minlength=len(texts))


def build_shard(columns: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> Shard:
    """The index over a line of stretches."""
    name, *places = columns
    names, symbol = np.unique(name[name != 0], return_inverse=True)
    line = np.zeros(len(name), np.int64)
    line[name != 0] = symbol + 1
    return Shard(names, FMIndex(line, len(names) + 1), a, b, *places)


def search_shard(shard: Shard, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the shard's line and numbers of the patterns found there.

    ``patterns`` holds a row of names each, padded at the right. Those with a word that the shard lacks are not searched.
    """
    symbol = np.searchsorted(shard.names, patterns)
    held = shard.names[np.minimum(symbol, len(shard.names) - 1)] == patterns
    live = np.flatnonzero((held | (np.arange(patterns.shape[1]) >= lengths[:, None])).all(axis=1))
    low, high = shard.index.search(symbol[live] + 1, lengths[live])
    many = high - low
    rows = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return shard.index.locate(rows), np.repeat(live, many)


def _sliced(batches: Iterator[pa.RecordBatch], texts: int) -> Iterator[pa.RecordBatch]:
    """Some rows at a time, with some megabytes of text or one text."""
    for batch in batches:
        size = pc.binary_length(batch.column(texts)).fill_null(0).to_numpy()
        at = 0
        while at < batch.num_rows:
            fits = np.searchsorted(np.cumsum(size[at:at + SLICE_ROWS]), SLICE_BYTES, "right")
            yield batch.slice(at, max(1, int(fits)))
            at += max(1, int(fits))


def _window_rows(window: int):
    """All runs of ``window`` words of the items, as the words' names end to end; a shorter item, but not an empty one, is one run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _sliced(batches, 1):
            names, counts = word_names([t.translate(_SPACED) for t in some.column(1).to_pylist()])
            ends = np.cumsum(counts)
            for item, n, end in zip(some.column(0).to_pylist(), counts.tolist(), ends.tolist(), strict=True):
                size = min(window, n)
                for at in range(end - n, end - size + 1 if n else 0, SLICE_ROWS):
                    words = names[at:min(at + SLICE_ROWS + size - 1, end)]
                    patterns = [words[k:k + size].tobytes() for k in range(len(words) - size + 1)]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(patterns), pa.string()), pa.array(patterns, pa.binary())], ["item", "pattern"])

    return run


def _names_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            names = np.unique(np.frombuffer(b"".join(batch.column(0).slice(at, SLICE_ROWS).to_pylist()), np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(names)], ["name"])


def _block_rows(window: int, block: int):
    """Blocks of ``block`` windows: numbers, lengths, and patterns padded to ``window`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, numbers = [], []

        def row() -> pa.RecordBatch:
            lengths = np.array([len(p) // 8 for p in patterns], np.int64)
            padded = b"".join(p.ljust(8 * window, b"\0") for p in patterns)
            values = [np.array(numbers, np.int64).tobytes(), lengths.tobytes(), padded]
            patterns.clear()
            numbers.clear()
            return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], ["numbers", "lengths", "patterns"])

        for batch in batches:
            for number, pattern in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                numbers.append(number)
                patterns.append(pattern)
                if len(patterns) >= block:
                    yield row()
        if patterns:
            yield row()

    return run


def _shard_rows(known: Broadcast, shortest: int, window: int, shard_words: int):
    """Shards of about ``shard_words`` indexed words, one a row; a longer line is cut, with the words of a window repeated."""

    def shards(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        a, b = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        before = np.cumsum([0, *[len(h[0]) for h in held[:-1]]])
        for h, n in zip(held, before.tolist(), strict=True):
            h[2][1] += n
        columns = [np.concatenate([h[2][k] for h in held]) for k in range(5)]
        n = len(columns[0])
        step = -(-n // max(1, n // shard_words))
        for at in range(0, n, step):
            part = [c[at:at + step + window - 1] for c in columns]
            if (part[0] != 0).any():
                texts, part[1] = np.unique(part[1], return_inverse=True)
                row = pickle.dumps(build_shard(part, a[texts], b[texts]), 5)
                yield pa.RecordBatch.from_arrays([pa.array([row], pa.binary())], ["shard"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for some in _sliced(batches, 2):
            columns = stretches(some.column(2).to_pylist(), known.value, shortest)
            if len(columns[0]):
                held.append((some.column(0).to_numpy(), some.column(1).to_numpy(), columns))
                size += len(columns[0])
            if size >= shard_words:
                yield from shards(held)
                held, size = [], 0
        if size:
            yield from shards(held)

    return run


def _search_rows(window: int):
    """What each block of windows finds in each shard: stretches of hit words, and the windows found, by text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                packed, numbers, lengths, patterns = (batch.column(k)[i].as_py() for k in range(4))
                shard, numbers, lengths = pickle.loads(packed), np.frombuffer(numbers, np.int64), np.frombuffer(lengths, np.int64)
                place, found = search_shard(shard, np.frombuffer(patterns, np.uint64).reshape(-1, window), lengths)
                if len(place):
                    yield _found_rows(shard, place, lengths[found], numbers[found])

    return run


def _found_rows(shard: Shard, place: np.ndarray, length: np.ndarray, window: np.ndarray) -> pa.RecordBatch:
    n = len(shard.text) + 1
    inside = np.cumsum(np.bincount(place, minlength=n) - np.bincount(place + length, minlength=n + 1)[:n]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8)])))
    first, last = edges[::2], edges[1::2] - 1
    pairs = np.unique(np.stack([shard.text[place], window]), axis=1)
    text = np.concatenate([shard.text[first], pairs[0]])
    none, some = len(first), pairs.shape[1]
    stretch = [pa.array(np.concatenate([v, np.zeros(some, np.int32)]), pa.int32(), mask=np.arange(none + some) >= none) for v in (shard.number[first], shard.number[last], shard.start[first], shard.stop[last])]
    windows = pa.array(np.concatenate([np.zeros(none, np.int64), pairs[1]]), mask=np.arange(none + some) < none)
    return pa.RecordBatch.from_arrays([pa.array(shard.a[text]), pa.array(shard.b[text]), windows, *stretch], ["a", "b", "window", "first", "last", "start", "stop"])


def _merged(firsts: list, lasts: list, starts: list, stops: list) -> list:
    """Of each text's stretches, which may overlap: the numbers of the words inside, and the merged stretches' characters."""
    out: list[list] = [[], [], []]
    for row in zip(firsts, lasts, starts, stops, strict=True):
        first, last, start, stop = (np.array(x, np.int64) for x in row)
        order = np.argsort(first, kind="stable")
        first, start, reach, end = first[order], start[order], np.maximum.accumulate(last[order]), np.maximum.accumulate(stop[order])
        heads = np.flatnonzero(np.append(True, first[1:] > reach[:-1] + 1))
        tails = np.append(heads[1:], len(first)) - 1
        out[0].append(np.concatenate([np.arange(f, r + 1) for f, r in zip(first[heads], reach[tails], strict=True)]))
        out[1].append(start[heads])
        out[2].append(end[tails])
    return out


def _stored_shards(shards: DataFrame) -> DataFrame:
    """Rows of megabytes, written so that the Parquet writer looks at its size after each."""
    folder = new_folder(shards.sparkSession, "shards")
    looks = {f"parquet.{unit}.size.row.check.{end}": "1" for unit in ("block", "page") for end in ("min", "max")}
    shards.write.options(**looks, **{"parquet.block.size": str(32 << 20)}).parquet(folder)
    return shards.sparkSession.read.schema(shards.schema).parquet(folder)


def _facts(texts: DataFrame, benchmark: DataFrame, window: int, block_bytes: int, shard_words: int) -> DataFrame | None:
    """By key of a text in which a window occurs: ``hit_words``, ``items``, ``spans``. None without any window."""
    each = stored(benchmark.mapInArrow(_window_rows(window), "item string, pattern binary").withColumn("window", F.xxhash64("pattern")), "test-windows")
    windows = stored(each.select("window", "pattern").distinct(), "distinct-test-windows")
    n, shortest = windows.agg(F.count("*"), F.min(F.length("pattern"))).first()
    if not n:
        return None
    names = stored(windows.select("pattern").mapInArrow(_names_of, "name long").distinct(), "test-words")
    known = texts.sparkSession.sparkContext.broadcast(name_filter(names, "name", names.count()))
    block = max(1, block_bytes // (8 * window + 16))
    n_blocks = -(-n // block)
    blocks = stored(windows.repartition(n_blocks).mapInArrow(_block_rows(window, block), "numbers binary, lengths binary, patterns binary"), "window-blocks")
    shards = texts.mapInArrow(_shard_rows(known, shortest // 8, window, shard_words), "shard binary")
    if n_blocks > 1:
        shards = _stored_shards(shards)
    found = stored(shards.crossJoin(blocks).mapInArrow(_search_rows(window), _FOUND), "occurrences")
    ranges = found.where("window is null").groupBy("a", "b").agg(F.collect_set(F.struct("first", "last", "start", "stop")).alias("r"))
    longs = T.ArrayType(T.LongType())
    fields = [T.StructField(name, longs) for name in ("hit_words", "start", "stop")]
    reads = ["first", "last", "begin", "end"]
    hits = add_columns(ranges.select("a", "b", *[F.col(f"r.{c}").alias(n) for c, n in zip(("first", "last", "start", "stop"), reads, strict=True)]), lambda: _merged, reads, fields, reads)
    owners = each.select("window", "item").distinct()
    items = found.where("window is not null").select("a", "b", "window").distinct().join(owners, "window").groupBy("a", "b").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return stored(hits.join(items, ["a", "b"]).select("a", "b", "hit_words", "items", F.arrays_zip("start", "stop").alias("spans")), "contaminated-texts")


def _counted(keyed: DataFrame, text: str, held: Broadcast | None, hit: bool) -> DataFrame:
    """Rows whose key ``a`` is (``hit``) or is not in the filter, with ``n_words``."""
    rows = keyed
    if not isinstance(keyed.schema[text].dataType, T.StringType):
        rows = keyed.withColumn("as_text", F.col(text).cast("string"))
    names = [*rows.columns, "n_words"]
    body, key = names.index("as_text" if "as_text" in names else text), names.index("a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if held is not None:
                may_hit = held.value.holds(batch.column(key).fill_null(0).to_numpy()) & batch.column(key).is_valid().to_numpy(zero_copy_only=False)
                batch = batch.filter(pa.array(may_hit == hit))
            if batch.num_rows:
                counts = [count_words(some.column(body).cast(pa.binary()).to_pylist()) for some in _sliced([batch], body)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(counts), pa.int64())], names)

    return mapped(rows, run, T.StructType([*rows.schema.fields, T.StructField("n_words", T.LongType())]))


@any_names("text")
def find_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
                       window: int = WINDOW, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Add ``n_words``, ``hit_words`` (their numbers, ascending), ``items`` (ids as text, sorted) and ``spans`` to every document.

    Words are compared with A-Z lower-cased, by names of 64 bits. Each task turns its documents into shards of
    about ``shard_words`` indexed words and builds an FM-index over each, once: the Burrows-Wheeler transform of its
    words, ranks by a wavelet tree, and a sample of suffix positions. All windows of the test items are searched
    backward; the occurrences' words are the hits. ``spans`` are the removal spans: stretches of hit words, merged,
    from the first character of the first to behind the last.

    The test items are the query set, against all shards, in blocks of about ``block_bytes``; neither items nor windows
    pass through the driver. Only a filter of the items' words does, of 64 MB at most. One block meets the shards as they are
    built; for more, the shards are written to the shared folder and meet each block there. What is found goes by keys of
    128 bits of the texts. A filter of these keys, of 64 MB at most, tells the documents that meet them in a join; the others
    are not moved. ``docs`` is read three times.

    Hits are sets, so equal windows of several items, repeated items and repeated rows change nothing else. Nulls have no
    words; an item with a null id or text is no item. Empty benchmark: no hits. Empty documents: no rows.
    Columns with the added names are replaced, all others kept.
    """
    rows = without(docs, ["n_words", "hit_words", "items", "spans"])
    body = F.col(text).cast("string")
    keys = [F.when(F.length(body) > 0, k) for k in (F.xxhash64(body), F.xxhash64(F.lit(1), body))]
    keyed = rows.select("*", keys[0].alias("a"), keys[1].alias("b"))
    texts = keyed.select("a", "b", body.cast("binary").alias("body")).where("a is not null")
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").cast("binary").alias("body")).dropna()
    facts = _facts(texts, items, window, block_bytes, shard_words)
    held = None if facts is None else docs.sparkSession.sparkContext.broadcast(name_filter(facts, "a", facts.count()))
    kinds = {"hit_words": "array<long>", "items": "array<string>", "spans": "array<struct<start:long,stop:long>>"}
    none = {name: F.array().cast(kind).alias(name) for name, kind in kinds.items()}
    clean = _counted(keyed, text, held, False).select(*rows.columns, "n_words", *none.values())
    if facts is None:
        return clean
    met = _counted(keyed, text, held, True).join(facts, ["a", "b"], "left")
    found = [F.coalesce(F.col(name).cast(kind), none[name]).alias(name) for name, kind in kinds.items()]
    return clean.unionByName(met.select(*rows.columns, "n_words", *found))


def remove_spans(text: Column, spans: Column) -> Column:
    """``text`` without its ``spans``, which ascend and do not overlap."""
    def step(state: Column, span: Column) -> Column:
        piece = F.substring(text, (state["at"] + 1).cast("int"), (span["start"] - state["at"]).cast("int"))
        return F.struct(span["stop"].alias("at"), F.concat(state["kept"], piece).alias("kept"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("kept"))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, lambda s: F.concat(
        s["kept"], F.substring(text, (s["at"] + 1).cast("int"), F.length(text)))))


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(items, ","), 256)

