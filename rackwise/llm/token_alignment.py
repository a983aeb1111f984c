"""Two tokenizers over the same texts: where their tokens end together, and how often their ids meet there."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rackwise.llm.common import mapped, stored, unused, without

BYTE_FILE, PIECE_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
HEAD_PAIRS = 1 << 18  # pairs of ids whose counts every task holds: 17 bytes each; the rest is joined
CHUNKS_HELD, SLICE_CHARS, JOINED = 300_000, 1 << 21, 2000
ADDED = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
_B_BITS = 20
# A new chunk starts at a space after something else than white space, unless only white space follows.
_CHUNK = re.compile(r"\s*\S+(?:[^\S ]\s*\S*|\s+\Z)*|\s+")
_UNEVEN = re.compile(r"\s |\s\Z")


def _byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable ones as themselves, the others from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteTokenizer:
    """A byte-level BPE from its JSON file; strings of special tokens are plain text."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, vocab = _byte_letters(), spec["model"]["vocab"]
        special = {t["id"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(map(letters.__getitem__, token)): i for token, i in vocab.items() if i not in special}
        self.bytes_of = [b""] * (max(vocab.values()) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        split = spec.get("pre_tokenizer") or {}
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex"):
            raise ValueError(f"{path} may form tokens across spaces")
        self.lengths = np.array([len(t) for t in self.bytes_of], np.int64)
        self._encode = self._ranked(spec, vocab, ranks) or self._plain(path)

    @staticmethod
    def _ranked(spec: dict, vocab: dict, ranks: dict):
        """The same tokens faster, where ids are numbered in the order of merges, as this kind of file mostly does."""
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        if any(vocab.get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        import tiktoken

        # Fixed value: how byte-level BPE of this kind splits a text before merging.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        whole = tiktoken.Encoding("plain", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: whole.encode_to_numpy(text, disallowed_special=())

    @staticmethod
    def _plain(path: str):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        whole.encode_special_tokens = True
        return lambda text: whole.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        return np.asarray(self._encode(text), np.int64)


class PieceTokenizer:
    """A sentence-piece model with byte fallback; it puts a space before the text."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        self._model = SentencePieceProcessor(model_file=path)
        pieces = [self._model.id_to_piece(i) for i in range(self._model.vocab_size())]
        self.bytes_of = [bytes([int(p[3:-1], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.lengths = np.array([len(t) for t in self.bytes_of], np.int64)
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError(f"{path} may form tokens across spaces")

    def encode(self, text: str) -> np.ndarray:
        return np.array(self._model.encode(text), np.int64)


def chunks_of(text: str) -> list[str]:
    """The text cut before every space that follows something else than white space; each chunk without its first space.

    Joined by spaces they give the text back. No token of either tokenizer spans a cut.
    """
    return text.split(" ") if text and not _UNEVEN.search(" " + text) else [c[1:] for c in _CHUNK.findall(" " + text)]


def coalesce(a_length: np.ndarray, b_length: np.ndarray, a_base: np.ndarray, b_base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Groups and overlaps of A and B tokens that lie end to end, given their lengths in bytes and their places' start.

    All tokens are sorted by start; a group breaks where a start reaches the running maximum of the
    ends so far. Within the groups every A token is expanded by the B tokens it overlaps. Returns the
    group of each A token, of each B token, and the overlapping pairs as (A place, B place).
    """
    a_start, b_start = a_base, b_base
    a_end, b_end = a_start + a_length, b_start + b_length
    start, end = np.concatenate([a_start, b_start]), np.concatenate([a_end, b_end])
    order = np.lexsort((np.repeat([0, 1], [len(a_start), len(b_start)]), start))
    reached = np.maximum.accumulate(end[order])
    breaks = np.ones(len(order), bool)
    breaks[1:] = start[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(breaks) - 1
    first = np.searchsorted(b_end, a_start, "right")
    times = np.searchsorted(b_start, a_end, "left") - first
    left = np.repeat(np.arange(len(a_start)), times)
    right = np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
    return group[:len(a_start)], group[len(a_start):], left, right


@dataclass
class Aligned:
    """What a task knows of the chunks that it met: one place in every list per chunk."""

    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    fine: np.ndarray
    texts: list[str]
    codes: np.ndarray  # links of all chunks, one chunk after the other: A id and B id in one number


def _encoded(chunks: Sequence[str], a: ByteTokenizer, b: PieceTokenizer) -> Iterator[tuple[list[bool], list[int], np.ndarray, np.ndarray]]:
    """Of some of the chunks at a time: which ones the tokens give back, their lengths in bytes (0 if not), and both sides' ids.

    Chunks are encoded joined by spaces, ``JOINED`` at a time, as no token spans a space between them.
    Chunks that end in white space go alone, and so do all chunks of a stretch that isn't given back whole.
    """
    joined = [k for k, c in enumerate(chunks) if c and not c[-1].isspace()]
    if len(joined) != len(chunks) and joined != list(range(len(joined))):
        raise ValueError("chunks that end in white space come last")
    stretches = [(at, min(at + JOINED, len(joined))) for at in range(0, len(joined), JOINED)] + [(k, k + 1) for k in range(len(joined), len(chunks))]
    while stretches:
        start, stop = stretches.pop(0)
        some = chunks[start:stop]
        text = " ".join(some)
        ids, whole = (a.encode(" " + text), b.encode(text)), (" " + text).encode("utf-8", "replace")
        if all(b"".join(map(side.bytes_of.__getitem__, i.tolist())) == whole for side, i in zip((a, b), ids, strict=True)):
            yield [True] * len(some), [len(c.encode()) + 1 for c in some], *ids
        elif len(some) == 1:
            yield [False], [0], np.zeros(0, np.int64), np.zeros(0, np.int64)
        else:
            stretches[:0] = [(k, k + 1) for k in range(start, stop)]


def align_chunks(chunks: Sequence[str], a: ByteTokenizer, b: PieceTokenizer, with_texts: bool = True) -> Aligned:
    """Encode and align the chunks, laid end to end. A chunk whose bytes the tokens don't give back is not ``fine``."""
    parts = list(_encoded(chunks, a, b))
    fine = np.array([f for p in parts for f in p[0]], bool)
    chunk_end = np.cumsum([n for p in parts for n in p[1]])
    flat_a, flat_b = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in (2, 3))
    a_length, b_length = a.lengths[flat_a], b.lengths[flat_b]
    a_end, b_end = np.cumsum(a_length), np.cumsum(b_length)
    n_a, n_b = (np.diff(np.searchsorted(end, chunk_end, "right"), prepend=0) for end in (a_end, b_end))
    a_group, b_group, left, right = coalesce(a_length, b_length, a_end - a_length, b_end - b_length)
    together = a_end[left] == b_end[right]
    left, right = left[together], right[together]
    chunk_of_a = np.repeat(np.arange(len(chunks)), n_a)
    n_links = np.bincount(chunk_of_a[left], minlength=len(chunks))
    ends_group = np.ones(len(a_group), bool)
    ends_group[:-1] = a_group[1:] != a_group[:-1]
    n_groups = np.bincount(chunk_of_a[ends_group], minlength=len(chunks))
    texts = _group_texts(n_a + n_b, flat_a, flat_b, a_group, b_group, len(a.bytes_of) + len(b.bytes_of)) if with_texts else []
    return Aligned(n_a, n_b, n_groups, n_links, fine, texts, flat_a[left] << _B_BITS | flat_b[right])


@cache
def _marked_numbers(n: int) -> list[str]:
    """Every id followed by ``,``, then every id followed by ``|``, then by ``;``."""
    return [f"{i}{mark}" for mark in ",|;" for i in range(n)]


def _group_texts(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, a_group: np.ndarray, b_group: np.ndarray, n_ids: int) -> list[str]:
    """Of each chunk, by its number of tokens, its groups as ``a1,a2|b1;a3|b2``."""
    side = np.repeat([0, 1], [len(a), len(b)])
    group, ids = np.concatenate([a_group, b_group]), np.concatenate([a, b])
    order = np.argsort(group * 2 + side, kind="stable")
    group, side, ids = group[order], side[order], ids[order]
    after = np.zeros(len(ids), np.int64)
    after[:-1] = np.where(group[1:] != group[:-1], 2, (side[1:] != side[:-1]).astype(np.int64))
    words = list(map(_marked_numbers(n_ids).__getitem__, (ids + after * n_ids).tolist()))
    out, at = [], 0
    for end in np.cumsum(sizes).tolist():
        out.append("".join(words[at:end])[:-1])
        at = end
    return out


class _Reader:
    """Cuts texts into chunks and keeps what is known of each; forgets all when it holds too many."""

    def __init__(self, folder: str, counts: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
        self.a, self.b = ByteTokenizer(os.path.join(folder, BYTE_FILE)), PieceTokenizer(os.path.join(folder, PIECE_FILE))
        self.counts = counts
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.texts: list[str] = []
        self.columns = [np.zeros(0, np.int64) for _ in range(8)]
        self.codes, self.rest = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, docs: list[list[str]]) -> None:
        new = sorted(set(chain.from_iterable(docs)) - self.known.keys(), key=lambda c: not c or c[-1].isspace())
        if not new:
            return
        more = align_chunks(new, self.a, self.b, self.counts is not None)
        self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
        self.texts += more.texts
        columns = [more.n_a, more.n_b, more.n_groups, more.n_links, (~more.fine).astype(np.int64)]
        owner = np.repeat(np.arange(len(new)), more.n_links)
        unknown = np.zeros(len(more.codes), bool)
        if self.counts is not None:
            codes, counts, best = self.counts
            place = np.minimum(np.searchsorted(codes, more.codes), max(0, len(codes) - 1))
            unknown = codes[place] != more.codes if len(codes) else ~unknown
            value, is_best = np.where(unknown, 0, counts[place] if len(codes) else 0), ~unknown & (best[place] if len(codes) else False)
            columns += [_sums(owner, value, len(new)), _sums(owner, is_best.astype(np.int64), len(new))]
        else:
            columns += [np.zeros(len(new), np.int64)] * 2
        columns.append(np.bincount(owner[unknown], minlength=len(new)))
        self.columns = [np.concatenate(pair) for pair in zip(self.columns, columns, strict=True)]
        if self.counts is None:
            self.codes = np.concatenate([self.codes, more.codes])
        self.rest = np.concatenate([self.rest, more.codes[unknown]])

    def places(self, docs: list[list[str]]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(docs)), np.int64)


def _sums(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.add.at(out, owner, values)
    return out


def _slices(texts: list[bytes | None]) -> Iterator[tuple[int, list[list[str]]]]:
    """Documents as lists of chunks, a bounded amount of text at a time, and the place of the first."""
    docs: list[list[str]] = []
    at = size = 0
    for k, raw in enumerate(texts):
        try:
            text = raw.decode("utf-8") if raw is not None else ""
        except UnicodeDecodeError:  # such bytes come back from no token
            text = ""
        docs.append(chunks_of(text) if text else [])
        size += len(text)
        if size >= SLICE_CHARS:
            yield at, docs
            docs, at, size = [], k + 1, 0
    if docs:
        yield at, docs


def _expand(sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Places in a flat array of the items of each of ``which``, where item lists of these ``sizes`` lie end to end."""
    starts, times = (np.cumsum(sizes) - sizes)[which], sizes[which]
    return np.arange(int(times.sum())) + np.repeat(starts - (np.cumsum(times) - times), times)


def _fine_docs(reader: _Reader, docs: list[list[str]], places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The document of each chunk place, and which documents have no chunk that isn't fine."""
    owner = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    return owner, np.bincount(owner, weights=reader.columns[4][places], minlength=len(docs)) == 0


def _pair_counts(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder)
        seen = np.zeros(0, np.int64)

        def flush() -> pa.RecordBatch:
            codes, back = np.unique(reader.codes, return_inverse=True)
            return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(_sums(back, np.repeat(seen, reader.columns[3]), len(codes)))], ["pair", "n"])

        for batch in batches:
            for _, docs in _slices(batch.column(0).to_pylist()):
                if len(reader.known) > CHUNKS_HELD:
                    yield flush()
                    reader.clear()
                    seen = np.zeros(0, np.int64)
                reader.learn(docs)
                places = reader.places(docs)
                owner, fine = _fine_docs(reader, docs, places)
                seen = np.pad(seen, (0, len(reader.known) - len(seen))) + np.bincount(places[fine[owner]], minlength=len(reader.known))
        yield flush()

    return run


def pair_counts(docs: DataFrame, folder: str, text: str = "text") -> DataFrame:
    """``pair``, ``a``, ``b``, ``n`` and ``is_best``: how many links of all documents join the two ids, and whether
    no other A id is joined more often with this B id. Folded per task before the shuffle."""
    parts = docs.select(F.col(f"`{text}`").cast("string").cast("binary").alias("text")).mapInArrow(_pair_counts(folder), "pair long, n long")
    counts = parts.groupBy("pair").agg(F.sum("n").alias("n")).where("n > 0")
    b = F.col("pair").bitwiseAND((1 << _B_BITS) - 1)
    ids = counts.select("pair", F.shiftright("pair", _B_BITS).alias("a"), b.alias("b"), "n")
    return ids.withColumn("is_best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def align_tokens(docs: DataFrame, folder: str, text: str = "text", head_pairs: int = HEAD_PAIRS, keep_text: bool = True) -> DataFrame:
    """Add ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``.

    A encodes space and text, B puts the space itself. Byte offsets where tokens of both end cut the
    tokens into groups; a link is an A and a B token whose byte ranges end together. ``n_best``
    counts links whose pair of ids is as frequent in all documents as any pair of that B id,
    ``count_sum`` adds up how frequent the links' pairs are.

    Texts are cut at spaces that no token of either vocabulary spans (checked), and every task encodes
    and aligns a chunk once; a text of one long chunk is encoded as a whole. Counts of the
    ``head_pairs`` most frequent pairs go to every task; links of other pairs meet their counts in a join.

    A text that is null, empty, no valid UTF-8, or that the tokens don't give back byte by byte has
    zeros and '' for the digest, and adds nothing to any count. Repeated rows count each on its own.
    Empty table: no rows. Columns named as the added ones are replaced, all others kept, but for the
    text with ``keep_text=False``.
    """
    counts = stored(pair_counts(docs, folder, text), "pair-counts")
    head = counts.orderBy(F.col("n").desc(), "pair").limit(head_pairs).select("pair", "n", "is_best").toArrow().sort_by("pair")
    known = tuple(head.column(c).to_numpy() for c in ("pair", "n", "is_best"))
    shared = docs.sparkSession.sparkContext.broadcast(known)
    kept = without(docs, [c for c in ADDED if c.lower() != text.lower()])
    names = [f.name for f in kept.schema.fields]
    row, rest = unused("_row", names), unused("_rest", names)
    longs = [T.StructField(c, T.LongType()) for c in ADDED[:-1]]
    added = [*longs, T.StructField(ADDED[-1], T.StringType()), T.StructField(rest, T.ArrayType(T.LongType()))]
    place = names.index(text)
    passed = [k for k in range(len(names)) if keep_text or k != place]
    of_text = [F.col(f"`{c}`") if k != place else F.col(f"`{c}`").cast("string").cast("binary") for k, c in enumerate(names)]
    fields = [f if k != place else T.StructField(f.name, T.BinaryType()) for k, f in enumerate(kept.schema.fields)]
    result = T.StructType([*[fields[k] for k in passed], *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(folder, shared.value)
        for batch in batches:
            for at, part in _slices(batch.column(place).to_pylist()):
                if len(reader.known) > CHUNKS_HELD:
                    reader.clear()
                reader.learn(part)
                own = batch.slice(at, len(part)).columns
                yield pa.RecordBatch.from_arrays([*[own[k] for k in passed], *_judged(reader, part)], result.names)

    out = mapped(kept.select(*of_text), run, result)
    back = [F.col(f"`{c}`") if k != place else F.col(f"`{c}`").cast(kept.schema.fields[k].dataType).alias(c) for k, c in enumerate(names) if k in passed]
    if counts.count() <= head_pairs:
        return out.select(*back, *ADDED)
    numbered = stored(out.select(*back, *ADDED, F.col(f"`{rest}`")).withColumn(row, F.monotonically_increasing_id()), "aligned")
    links = numbered.where(F.size(rest) > 0).select(F.col(row).alias("_row"), F.explode(rest).alias("pair"))
    tail = links.join(counts.select("pair", "n", "is_best"), "pair").groupBy("_row").agg(F.sum("n").alias("_sum"), F.count_if("is_best").alias("_best"))
    joined = numbered.alias("d").join(tail.alias("t"), F.col(f"d.`{row}`") == F.col("t._row"), "left")
    more = {"count_sum": F.col("d.count_sum") + F.coalesce("t._sum", F.lit(0)), "n_best": F.col("d.n_best") + F.coalesce("t._best", F.lit(0))}
    return joined.select(*[F.col(f"d.`{names[k]}`") for k in passed], *[more.get(c, F.col(f"d.{c}")).alias(c) for c in ADDED])


def _judged(reader: _Reader, docs: list[list[str]]) -> list[pa.Array]:
    places = reader.places(docs)
    owner, fine = _fine_docs(reader, docs, places)
    sums = [np.where(fine, _sums(owner, reader.columns[k][places], len(docs)), 0) for k in (0, 1, 2, 3, 6, 5)]
    ends = np.cumsum([len(d) for d in docs]).tolist()
    digests, at, flat = [], 0, places.tolist()
    for end, ok in zip(ends, fine.tolist(), strict=True):
        some = ok and end > at
        digests.append(hashlib.sha256(";".join(map(reader.texts.__getitem__, flat[at:end])).encode()).hexdigest() if some else "")
        at = end
    used = places[fine[owner]]
    rest = reader.rest[_expand(reader.columns[7], used)]
    sizes = np.zeros(len(docs) + 1, np.int32)
    sizes[1:] = np.cumsum(np.bincount(owner[fine[owner]], weights=reader.columns[7][used], minlength=len(docs)))
    return [*[pa.array(s) for s in sums], pa.array(digests, pa.string()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(rest))]
