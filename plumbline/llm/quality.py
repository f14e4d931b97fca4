"""A quality classifier: random Fourier features, ridge regression and isotonic calibration.

Every text becomes a few dozen statistics of its characters, words and lines, each squashed to a
small range. Random Fourier features of the standardised statistics approximate a Gaussian kernel.
Each partition sums its part of the normal equations; the sums meet in a few tasks and the driver
solves a system whose size is the number of features. Raw scores of a fold that the fit did not see
are counted in bins, and the isotonic fit over these gives probabilities.

Labels of all allowed rows are used. Statistics and scores cover all documents.

Defined results: a null text is empty; empty texts are scored like others; rows with a null id are
scored and never learnt from; a document with several labels is learnt from once per label; labels
other than 0 and 1 are left out; without labels of both kinds every score is the share of ones, or
0.5 without any label; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, raw_texts, sliced, written

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = b"0123456789"
_MARKS = b".,;:!?"
_SYMBOLS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _MARKS and c not in b"'\"()-")
_END = re.compile(rb"[.!?][\"')]*\s*\Z")
NAMES = (
    "log_words", "log_chars", "word_length", "word_spread", "upper", "digits", "marks", "symbols", "pipes", "bangs", "not_ascii", "spaces",
    "distinct", "one_word", "top_word", "log_lines", "line_words", "line_spread", "equal_lines", "line_ends", "short_lines", "upper_words",
    "symbol_words", "equal_pairs", "adjacent", "byte_entropy", "longest_word", "first_upper",
)


def statistics(text: bytes | None) -> list[float]:
    """The statistics of one text, in the order of ``NAMES``; all finite."""
    raw = text or b""
    words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
    n, size, m = len(words), len(raw), len(lines)
    count = lambda chars: size - len(raw.translate(None, chars))
    per_char, per_word = (lambda x: x / size if size else 0.0), (lambda x: x / n if n else 0.0)
    lengths = np.fromiter(map(len, words), np.int64, n) if n else np.zeros(1, np.int64)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    top = max(seen.values(), default=0)
    upper, lower = count(_UPPER), count(_LOWER)
    line_words = np.array([len(x.split()) for x in lines] or [0])
    seconds = len(set(zip(words, words[1:])))
    freq = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) if size else np.ones(1)
    share = freq[freq > 0] / freq.sum()
    return [
        math.log1p(n), math.log1p(size), float(lengths.mean()), float(lengths.std()), upper / (upper + lower) if upper + lower else 0.0,
        per_char(count(_DIGIT)), per_char(count(_MARKS)), per_char(count(_SYMBOLS)), per_char(count(b"|")), per_char(count(b"!")),
        per_char(size - len(raw.decode("utf-8", "replace"))), per_char(count(b" \t\n\r\x0b\x0c")), per_word(len(seen)), per_word(sum(1 for c in seen.values() if c == 1)),
        per_word(top), math.log1p(m), math.log1p(float(line_words.mean())), float(line_words.std()) / (1 + float(line_words.mean())),
        1 - len(set(lines)) / m if m else 0.0, sum(1 for x in lines if _END.search(x)) / m if m else 0.0, float((line_words < 4).mean()),
        per_word(sum(1 for w in words if len(w) > 1 and w.isupper())), per_word(sum(1 for w in words if not w.translate(None, _SYMBOLS + _MARKS))),
        1 - seconds / (n - 1) if n > 1 else 0.0, sum(1 for a, b in zip(words, words[1:]) if a == b) / (n - 1) if n > 1 else 0.0,
        float(-(share * np.log2(share)).sum()), math.log1p(int(lengths.max())), per_word(sum(1 for w in words if w[:1].isupper())),
    ]


@dataclass(frozen=True)
class Settings:
    """Number of features, kernel width in standard deviations per statistic, ridge and bins."""

    features: int = 384
    width: float = 4.0
    ridge: float = 1e-3
    bins: int = 512
    seed: int = 7
    combine: int = 8


@dataclass
class Model:
    """Everything that scoring needs; of fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    turns: np.ndarray
    shifts: np.ndarray
    weights: np.ndarray
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))
    constant: float | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        wave = np.sqrt(2 / len(self.shifts)) * np.cos(z @ self.turns + self.shifts)
        return np.concatenate([np.ones((len(z), 1)), 0.1 * z, wave], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(stats), self.constant)
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def isotonic(at: np.ndarray, ones: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over counted bins: (block centres, shares), both rising.

    Each block is smoothed by half a count of either kind, and equal shares are parted by a tiny
    slope so that the order of raw scores is kept.
    """
    blocks: list[list[float]] = []
    for x, k, m in zip(at, ones, n):
        blocks.append([x * m, float(k), float(m)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    centre = np.array([b[0] / b[2] for b in blocks])
    share = np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])
    share = np.maximum.accumulate(share)
    ends = [centre[0] - 1, *centre, centre[-1] + 1]
    levels = [share[0] * 0.5, *share, 1 - (1 - share[-1]) * 0.5]
    return np.array(ends), np.array(levels)


def solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Gaussian elimination for a positive definite system, without threads of a linear algebra library."""
    m, n = np.column_stack([a, b]).astype(float), len(a)
    for k in range(n - 1):
        m[k + 1 :, k:] -= np.outer(m[k + 1 :, k] / m[k, k], m[k, k:])
    x = np.zeros(n)
    for k in range(n - 1, -1, -1):
        x[k] = (m[k, n] - (m[k, k + 1 : n] * x[k + 1 :]).sum()) / m[k, k]
    return x


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and statistics of every row, written once."""
    kind = only(docs, "doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 8 << 20):
            stats = np.array([statistics(t) for t in raw_texts(batch.column("text"))], dtype=np.float32)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(stats.ravel()), len(NAMES)).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), flat], names=["doc_id", "stats"])

    return written(only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, stats array<float>"), "statistics")


def fold_of(doc_id: Column) -> Column:
    """0 to 3; rows without an id have none."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.asarray(batch.column("stats").flatten(), dtype=np.float64).reshape(-1, len(NAMES))


def _equations(rows: DataFrame, model: Model, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Sums of x xᵀ and x y: per partition, then in a few tasks, then here."""
    size = len(model.turns[0]) + len(NAMES) + 1
    groups = settings.combine

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                x = model.features(_matrix(piece))
                y = np.asarray(piece.column("quality"), dtype=np.float64) - 0.5
                total += x.T @ np.concatenate([x, y[:, None]], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % groups], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["slot", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * (size + 1))
        for batch in batches:
            for raw in batch.column("sums"):
                total += np.frombuffer(raw.as_buffer(), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    sums = rows.select("stats", "quality").mapInArrow(part, "slot int, sums binary").repartition(groups, "slot").mapInArrow(add, "sums binary")
    total = sum(np.frombuffer(r["sums"], np.float64) for r in sums.collect()).reshape(size, size + 1)
    return total[:, :size], total[:, size]


def fit(stats: DataFrame, labels: DataFrame, settings: Settings | None = None, held_out: int = 2, calibrate: int = 3) -> Model:
    """Fit on the labelled rows outside ``held_out``; the fold ``calibrate`` serves the isotonic fit."""
    settings = settings or Settings()
    names = [F.col("stats")[i] for i in range(len(NAMES))]
    moments = stats.agg(*[F.avg(c) for c in names], *[F.stddev_pop(c) for c in names]).first()
    mean, spread = (np.array([0.0 if v is None else v for v in part]) for part in (moments[: len(NAMES)], moments[len(NAMES) :]))
    rng = np.random.default_rng(settings.seed)
    turns = rng.normal(size=(len(NAMES), settings.features)) / settings.width
    model = Model(mean, np.where(spread > 1e-9, spread, 1.0), turns, rng.uniform(0, 2 * np.pi, settings.features), np.zeros(0))
    known = only(labels, "doc_id", "quality").select("doc_id", F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    rows = written(stats.join(known, "doc_id").withColumn("fold", fold_of(F.col("doc_id"))).where(F.col("fold") != held_out), "labelled")
    aside = (F.col("fold") == calibrate).alias("aside")
    counts = {(r["aside"], r["quality"]): r["n"] for r in rows.groupBy(aside, "quality").agg(F.count("*").alias("n")).collect()}
    total, ones = sum(counts.values()), sum(n for (_, q), n in counts.items() if q == 1)
    if not 0 < ones < total:
        model.constant = ones / total if total else 0.5
        return model
    parted = all(counts.get((c, q)) for c in (True, False) for q in (0, 1))
    learn = rows.where(F.col("fold") != calibrate) if parted else rows
    a, b = _equations(learn, model, settings)
    model.weights = solve(a + settings.ridge * max(1.0, a[0, 0]) / len(a) * np.eye(len(a)), b)
    bins = settings.bins

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.clip(np.floor((model.raw(_matrix(batch)) + 1) / 2 * bins), 0, bins - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("quality")], names=["bin", "quality"])

    check = rows.where(F.col("fold") == calibrate) if parted else rows
    found = check.select("stats", "quality").mapInArrow(binned, "bin int, quality int").groupBy("bin").agg(F.sum("quality").alias("ones"), F.count("*").alias("n")).orderBy("bin").collect()
    at = np.array([(r["bin"] + 0.5) / bins * 2 - 1 for r in found])
    model.knots, model.levels = isotonic(at, np.array([r["ones"] for r in found]), np.array([r["n"] for r in found]))
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of the statistics."""
    kind = stats.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch)))], names=["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {kind}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``."""
    stats = document_statistics(docs)
    scored = score(stats, fit(stats, labels, settings))
    held = F.coalesce(fold_of(F.col("doc_id")) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
