"""Language of a text: the nearest of several clustered centroids per language, by cosine of TF-IDF n-gram vectors."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rackwise.llm.common import add_columns, any_names, without

UNDETERMINED = "und"
SLOTS = 4096
SAMPLE_DOCS = 2400
_CHUNK = 1 << 20
_FULL_SLOTS = 400
_LETTER = re.compile(r"[^\W\d_]")
# All that is neither an ASCII letter nor part of a longer UTF-8 sequence becomes a space.
_SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


def ngram_counts(text: str) -> np.ndarray:
    """How often byte bigrams and trigrams of the lower-cased text fall into each of ``SLOTS`` slots."""
    body = b" " + b" ".join(text.lower().encode("utf-8", "replace").translate(_SPACED).split()) + b" "
    counts = np.zeros(SLOTS)
    for at in range(0, len(body), _CHUNK):
        x = np.frombuffer(body[at:at + _CHUNK + 2], np.uint8).astype(np.uint32)
        two = x[:-1] * np.uint32(257) + x[1:]
        counts += np.bincount(two * np.uint32(2654435761) >> np.uint32(20), minlength=SLOTS)
        if len(x) > 2:
            three = two[:-1] * np.uint32(263) + x[2:]
            counts += np.bincount(three * np.uint32(2246822519) >> np.uint32(20), minlength=SLOTS)
    return counts


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-12)


@dataclass(frozen=True)
class LanguageModel:
    """Unit centroids (a column each), the language of each, the slots' idf, and the least cosine that each language accepts."""

    languages: tuple[str, ...]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def vectors(self, texts: list[str]) -> np.ndarray:
        counts = np.stack([ngram_counts(t) for t in texts])
        return _unit(np.log1p(counts) * self.idf).astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text its language's number, the cosine, and whether it is too far away to be accepted."""
        vectors = self.vectors(texts)
        cosines = vectors @ self.centroids
        best = cosines.argmax(axis=1)
        cosine = np.clip(cosines[np.arange(len(texts)), best], 0, 1).astype(float)
        # A short text fills few slots and so can't come as near to a centroid.
        filled = np.sqrt(np.minimum(1, (vectors > 0).sum(axis=1) / _FULL_SLOTS))
        return self.owner[best], cosine, ~(cosine >= self.least[self.owner[best]] * filled)


def _clusters(rows: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Spherical k-means from rows that lie far apart."""
    rng = np.random.default_rng(seed)
    centres = [rows[rng.integers(len(rows))]]
    while len(centres) < min(k, len(rows)):
        far = 1 - (rows @ np.stack(centres).T).max(axis=1)
        far = np.maximum(far, 0) + 1e-12
        centres.append(rows[rng.choice(len(rows), p=far / far.sum())])
    centres = np.stack(centres)
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(axis=1)
        centres = _unit(np.stack([rows[nearest == c].mean(axis=0) if (nearest == c).any() else centres[c] for c in range(len(centres))]))
    return centres


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each language and text that a task meets."""
    seen = set()
    for batch in batches:
        keys = list(zip(batch.column("lang").to_pylist(), batch.column("hash").to_pylist(), strict=True))
        new = []
        for i, key in enumerate(keys):
            if key not in seen:
                seen.add(key)
                new.append(i)
        if new:
            yield batch.take(pa.array(new, pa.int64()))


def _sample(labelled: DataFrame, bound: int) -> list:
    """At most ``bound`` distinct texts in all, as many from each language as it has or its share: those of least draw.

    Copies of a text in a language are one. Texts that may be among the least are found by a limit on
    the draw; each task passes on one copy of them, so that few rows are ranked.
    """
    hashed = labelled.select("lang", "text", F.xxhash64(F.lit("language"), "text").alias("hash"))
    counts = hashed.groupBy("lang").agg(F.count_distinct("hash").alias("texts")).collect()  # a row per language
    if not counts:
        return []
    share = max(1, bound // len(counts))
    part = F.lit(0.0)
    for r in counts:
        part = F.when(F.col("lang") == r["lang"], min(1.0, (share + 6 * share**0.5 + 18) / r["texts"])).otherwise(part)
    draw = F.pmod("hash", F.lit(1 << 30))
    near = hashed.where(draw / float(1 << 30) < part)
    distinct = near.mapInArrow(_firsts, near.schema).dropDuplicates(["lang", "hash"])
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(draw, "hash"))
    drawn = distinct.withColumn("rank", rank).where(F.col("rank") <= share).select("lang", "text")
    fields = [T.StructField("counts", T.BinaryType())]
    counted = add_columns(drawn, lambda: lambda texts: [[ngram_counts(t).astype(np.float16).tobytes() for t in texts]], ["text"], fields, ["text"])
    return counted.collect()


def fit_languages(labelled: DataFrame, clusters: int = 4, rounds: int = 12, sample_docs: int = SAMPLE_DOCS, seed: int = 5, slack: float = 0.5) -> LanguageModel | None:
    """Learn from ``text`` and ``lang``; rows where either is null, or the text has no letter, teach nothing.

    The model is fitted on a bounded sample of at most ``sample_docs`` distinct texts, or one of each
    language if that is more; copies count once. Their n-gram counts are taken on the executors. A language accepts a text whose cosine is at least
    ``slack`` times that which 99% of its sampled texts reach, less for texts of few n-grams. Nothing to learn from: None.
    """
    rows = _sample(labelled.select("text", "lang").where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")), sample_docs)
    if not rows:
        return None
    rows = sorted(rows, key=lambda r: (r["lang"], r["counts"]))
    counts = np.minimum(np.stack([np.frombuffer(r["counts"], np.float16) for r in rows]).astype(np.float32), 60000)
    idf = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0))) + 1
    vectors = _unit(np.log1p(counts) * idf)
    names = np.array([r["lang"] for r in rows])
    languages = tuple(sorted(set(names)))
    centres, owner, least = [], [], []
    for i, language in enumerate(languages):
        own = vectors[names == language]
        found = _clusters(own, clusters, rounds, seed)
        centres.append(found)
        owner += [i] * len(found)
        least.append(slack * np.quantile((own @ found.T).max(axis=1), 0.01))
    return LanguageModel(languages, np.array(owner), np.concatenate(centres).T.astype(np.float32), idf.astype(np.float32), np.array(least))


@any_names("text")
def identify_language(docs: DataFrame, model: LanguageModel | None, text: str = "text") -> DataFrame:
    """Add ``lang_pred``, ``score`` (cosine of the nearest centroid, 0 to 1) and ``rejected``.

    A text that is null or has no letter is ``und`` with score 0 and is rejected, and so is every
    text without a model. Any other text gets the language of its nearest centroid; it is rejected
    if it is further from it than that language accepts. Ties go to the first language. Texts are
    read whole, in pieces of a megabyte. Empty table: no rows. Columns with the added names are
    replaced, all others kept.
    """
    added = ["lang_pred", "score", "rejected"]
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]

    def judge(texts: list) -> list:
        languages, scores, rejected = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
        due = [i for i, t in enumerate(texts) if t and model and _LETTER.search(t)]
        for at in range(0, len(due), 256):
            part = due[at:at + 256]
            for i, o, c, far in zip(part, *model.predict([texts[i] for i in part]), strict=True):
                languages[i], scores[i], rejected[i] = model.languages[o], float(c), bool(far)
        return [languages, scores, rejected]

    kept = without(docs, added).withColumn("_text", F.col(text).cast("string"))
    return add_columns(kept, lambda: judge, ["_text"], fields, ["_text"])

