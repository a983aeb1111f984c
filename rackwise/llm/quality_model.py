"""Quality of a text: a ridge over random Fourier features of document statistics, calibrated by isotonic regression."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rackwise.llm.common import add_columns, any_names, without

N_STATISTICS = 18
SAMPLE_ROWS = 200_000
_SENTENCE_MARKS, _OTHER_MARKS = b".,;:?", b"!#$%&*|@^~<>{}[]\\=+_/"


def statistics(text: str | None) -> list[float]:
    """``N_STATISTICS`` numbers about a text; an empty or null text has zeros."""
    if not text:
        return [0.0] * N_STATISTICS
    raw = text.encode("utf-8", "replace")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = len(raw)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    beyond = int(counts[192:].sum())  # the first bytes of characters beyond ASCII
    digits = int(counts[48:58].sum())
    words = text.lower().split()
    k = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = set(zip(words, words[1:]))
    distinct = set(words)
    same = sum(map(str.__eq__, words, words[1:]))
    ends = text.split()
    return [
        np.log1p(len(words)), n / k, upper / max(1, upper + lower), (upper + lower + 2 * beyond) / n, digits / n,
        sum(int(counts[b]) for b in _SENTENCE_MARKS) / k, sum(int(counts[b]) for b in _OTHER_MARKS) / k,
        len(distinct) / k, len(pairs) / k, same / k, sum(map(len, distinct)) / max(1, len(distinct)),
        np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
        sum(map(str.isupper, ends)) / k, sum(map(str.istitle, ends)) / k, sum(map(str.isalpha, ends)) / k,
        len(zlib.compress(raw, 1)) / n, max(map(len, words), default=0) / 50,
    ]


@any_names("text")
def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Replace the column ``text`` by ``statistics``; all other columns are kept, a ``statistics`` column is replaced."""
    kept = without(docs, ["statistics"] + [text]).columns
    body = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text).cast("string").alias("_text"))
    field = T.StructField("statistics", T.ArrayType(T.DoubleType()))
    return add_columns(body, lambda: lambda texts: [[statistics(t) for t in texts]], ["_text"], [field], ["_text"])


@dataclass(frozen=True)
class QualityModel:
    mean: np.ndarray
    spread: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    steps: np.ndarray
    levels: np.ndarray

    def features(self, rows: np.ndarray) -> np.ndarray:
        x = np.clip((rows - self.mean) / self.spread, -6, 6)
        waves = np.cos(x @ self.directions + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, np.ones((len(rows), 1))])

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return self.features(rows) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        return np.interp(self.raw(rows), self.steps, self.levels)


def _matrix(rows: list) -> np.ndarray:
    return np.array(rows, float).reshape(len(rows), N_STATISTICS)


def isotonic(values: np.ndarray, ones: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over ascending ``values``: the blocks' mean values and their shares of ones."""
    blocks: list[list[float]] = []
    for v, o, c in zip(values, ones, counts, strict=True):
        blocks.append([v * c, o, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            v1, o1, c1 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + v1, blocks[-1][1] + o1, blocks[-1][2] + c1]
    table = np.array(blocks)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def fit_quality(labelled: DataFrame, waves: int = 192, width: float = 0.7, ridge: float = 1e-3, sample_rows: int = SAMPLE_ROWS, seed: int = 11) -> QualityModel | None:
    """Learn from ``statistics`` and ``label`` (0 or 1; other values and nulls teach nothing).

    Fitted on a bounded sample of about ``sample_rows`` rows, chosen by a hash of the statistics;
    fewer are taken whole. Every task sums the normal equations of its rows, Spark adds the tasks'
    sums entry by entry, and the driver gets one small matrix. The ridge scores of the same rows are
    counted in narrow bins by Spark, and isotonic regression over the bins gives the calibration.
    The kernel's width is ``width`` times the root of the number of statistics. Only one label, or
    none: the score is that label's share, or no model.
    """
    rows = labelled.where(F.col("label").isin(0, 1) & F.col("statistics").isNotNull()).select("statistics", F.col("label").cast("double").alias("label"))
    # The partitions that normal equations are summed over: as many as the sample's size asks for.
    total = rows.count()
    if not total:
        return None
    draw = F.pmod(F.xxhash64(F.lit(seed), "statistics"), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(draw < min(1.0, sample_rows / total)).repartition(max(2, min(total, sample_rows) // 8000 + 1))
    items = [F.element_at("statistics", i + 1) for i in range(N_STATISTICS)]
    moments = sample.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(items)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(items)]).first()
    if moments["m0"] is None:
        return None
    mean = np.array([moments[f"m{i}"] for i in range(N_STATISTICS)])
    spread = np.array([moments[f"s{i}"] for i in range(N_STATISTICS)])
    spread = np.where(spread > 1e-9, spread, 1.0)
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(N_STATISTICS, waves)) / (width * np.sqrt(N_STATISTICS))
    phases = rng.uniform(0, 2 * np.pi, waves)
    shell = QualityModel(mean, spread, directions, phases, np.zeros(waves + 1), np.array([0.0]), np.array([0.0]))
    size = waves + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, right = np.zeros((size, size)), np.zeros(size)
        for batch in batches:
            x = shell.features(_matrix(batch.column("statistics").to_pylist()))
            gram += x.T @ x
            right += x.T @ batch.column("label").to_numpy(zero_copy_only=False)
        both = np.hstack([gram, right[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(both.tolist(), pa.list_(pa.float64()))], ["row", "entries"])

    parts = sample.mapInArrow(sums, "row int, entries array<double>").select("row", F.posexplode("entries").alias("place", "entry"))
    both = np.zeros((size, size + 1))
    for r in parts.groupBy("row", "place").agg(F.sum("entry").alias("entry")).collect():
        both[r["row"], r["place"]] = r["entry"]
    weights = np.linalg.solve(both[:, :-1] + ridge * both[-1, -2] / size * np.eye(size), both[:, -1])
    ridged = QualityModel(mean, spread, directions, phases, weights, np.array([0.0]), np.array([0.0]))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = ridged.raw(_matrix(batch.column("statistics").to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array(np.round(np.clip(values, -1, 2) * 2000).astype(np.int32)), batch.column("label")], ["bin", "label"])

    bins = sample.mapInArrow(raw, "bin int, label double").groupBy("bin").agg(F.sum("label").alias("ones"), F.count("*").alias("n")).orderBy("bin").collect()
    steps, levels = isotonic(*(np.array([r[c] for r in bins], float) for c in ("bin", "ones", "n")))
    return QualityModel(mean, spread, directions, phases, weights, steps / 2000, levels)


def score_quality(rows: DataFrame, model: QualityModel | None) -> DataFrame:
    """Add ``score`` (0 to 1, higher: label 1 is likelier) from ``statistics``, which goes.

    Every row gets a score, empty texts too; without a model it is 0.5. A ``score`` column is
    replaced, all others kept. Empty table: no rows.
    """
    kept = without(rows, ["score"])
    field = T.StructField("score", T.DoubleType())

    def scores(listed: list) -> list:
        return [model.score(_matrix([s or [0.0] * N_STATISTICS for s in listed]))] if model else [[0.5] * len(listed)]

    return add_columns(kept, lambda: scores, ["statistics"], [field], ["statistics"])
