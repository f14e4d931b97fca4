"""Repeated passages by sparse suffix arrays.

Of all word suffixes only those are kept that begin at a content-selected position: the minimiser,
by hash, of a window of word k-grams. Equal passages select equal positions, and every passage of
``least`` words has such a position with at least ``prefix`` of its words to the right, so it is
enough to compare suffixes that agree in their first ``prefix`` words. Kept suffixes are counted by
the hash of that prefix; those that are alone drop out before any content moves. The others carry
the hashes of the words on either side. Up to ``pairs`` of one prefix are compared with each other:
matches are extended left and right from the position, and one of ``least`` words is a repeat. Of
more than ``pairs``, the windows of ``least`` words around each suffix are hashed and counted, and
windows counted twice are the repeats; this finds the same spans, in n log n. Extension goes as far
as the next selected position takes over.

Suffixes are streamed by prefix; a task holds those of one prefix. More than ``hot`` of one prefix are
not brought together: the hashes of their windows are counted in parts, over all tasks. Texts that
are equal are one node; with ``least`` words they repeat as a whole.

Defined results: a null text is empty; texts of fewer than ``least`` words have no repeats; null ids
and repeated rows are rows of their own; extra columns are ignored; a passage that occurs twice in
one text is a repeat.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import join_spread, mix64, only, raw_texts, sliced, written


@dataclass(frozen=True)
class Repeats:
    """Passages of at least ``least`` words; positions are minimisers of ``window`` k-grams."""

    least: int = 50
    prefix: int = 25
    k: int = 8
    pairs: int = 32
    block: int = 2048
    hot: int = 100_000

    @property
    def window(self) -> int:
        """Any ``least`` - ``prefix`` + k words in a row hold a selected k-gram."""
        return self.least - self.prefix + 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _rolled(value: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of ``width`` values."""
    n = len(value) - width + 1
    total, factor = np.zeros(max(n, 0), np.uint64), np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(width):
            total += value[k : k + len(total)] * factor
            factor *= np.uint64(0xD6E8FEB86659FD93)
    return mix64(total)


def selected(value: np.ndarray, repeats: Repeats) -> np.ndarray:
    """Positions of minimisers with ``prefix`` words to their right; of equal ones the rightmost."""
    if len(value) < repeats.least:
        return np.zeros(0, np.int64)
    grams = _rolled(value, repeats.k)[: len(value) - repeats.prefix + 1]
    view = np.lib.stride_tricks.sliding_window_view(grams, repeats.window)[:, ::-1]
    place = np.arange(len(view)) + repeats.window - 1 - np.argmin(view, axis=1)
    return np.unique(place)


def _values(text: bytes | None, hashes: _Hashes) -> np.ndarray:
    return mix64(np.array([*map(hashes.__getitem__, (text or b"").split())], dtype=np.uint64))


def _node(text: bytes | None) -> int:
    return xxhash.xxh3_64_intdigest(text or b"") - (1 << 63)


def _positions(docs: DataFrame, repeats: Repeats) -> DataFrame:
    """A row per row of ``docs``: node, words, and the kept suffixes' prefix hashes and positions."""
    kind = only(docs, "doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in sliced(batches, "text", 4 << 20):
            if len(hashes) > 500_000:
                hashes = _Hashes()
            nodes, words, prefixes, places = [], [], [], []
            for text in raw_texts(batch.column("text")):
                value = _values(text, hashes)
                at = selected(value, repeats)
                nodes.append(_node(text))
                words.append(len(value))
                prefixes.append((_rolled(value, repeats.prefix)[at] if len(at) else np.zeros(0, np.uint64)).tobytes())
                places.append(at.astype("<i4").tobytes())
            columns = [batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array(words, pa.int64()), pa.array(prefixes, pa.binary()), pa.array(places, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "node", "n_words", "prefixes", "places"])

    return written(only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, node bigint, n_words bigint, prefixes binary, places binary"), "suffix-positions")


def _exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            part = batch.slice(at, 1000)
            raw = [part.column(c).to_pylist() for c in ("prefixes", "places")]
            n = np.array([len(x) // 4 for x in raw[1]], dtype=np.int64)
            prefix, place = np.frombuffer(b"".join(raw[0]), np.int64), np.frombuffer(b"".join(raw[1]), "<i4")
            yield pa.RecordBatch.from_arrays([pa.array(prefix), pa.array(np.repeat(np.asarray(part.column("node")), n)), pa.array(place)], names=["prefix", "node", "at"])


def _contexts(repeats: Repeats):
    """Turns (text, node, positions) into suffixes with the words from ``prefix`` on and those before.

    A position is hot where its prefix is.
    """
    right_words, left_words = repeats.least - repeats.prefix, repeats.window - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in sliced(batches, "text", 1 << 20):
            if len(hashes) > 500_000:
                hashes = _Hashes()
            prefixes, nodes, ats, hots, right, left = [], [], [], [], [], []
            for text, node, marked in zip(raw_texts(batch.column("text")), batch.column("node").to_pylist(), batch.column("at").to_pylist()):
                value = _values(text, hashes)
                n, places = len(value), [m["at"] for m in marked]
                hots += [m["hot"] for m in marked]
                short = (value >> np.uint64(32)).astype(">u4")
                ahead, back = short.tobytes(), short[::-1].tobytes()
                prefixes.append(_rolled(value, repeats.prefix)[np.array(places)])
                nodes += [node] * len(places)
                ats += places
                right += [ahead[4 * (i + repeats.prefix) : 4 * (i + repeats.prefix + right_words)] for i in places]
                left += [back[4 * (n - i) : 4 * (n - i + left_words)] for i in places]
            columns = [pa.array(np.concatenate([*prefixes, np.zeros(0, np.uint64)]).view(np.int64)), pa.array(nodes, pa.int64()), pa.array(ats, pa.int32()), pa.array(hots, pa.bool_()), pa.array(right, pa.binary()), pa.array(left, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["prefix", "node", "at", "hot", "right", "left"])

    return run


def _windows(repeats: Repeats):
    """Hashes of all windows of ``least`` words that hold a suffix's prefix: (window, node, start)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            for prefix, node, at, right, left in zip(*[batch.column(c).to_pylist() for c in ("prefix", "node", "at", "right", "left")]):
                middle = prefix.to_bytes(8, "little", signed=True)
                for s in range(len(left) // 4 + 1):
                    ahead = 4 * (repeats.least - repeats.prefix - s)
                    if 0 <= ahead <= len(right):
                        out.append((xxhash.xxh3_64_intdigest(left[: 4 * s] + b"|" + middle + right[:ahead]) - (1 << 63), node, at - s))
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int32())], names=["window", "node", "start"])

    return run


def _shared(a: bytes, b: bytes) -> int:
    """Number of equal 4-byte values at the start."""
    n = min(len(a), len(b)) // 4
    if a[: 4 * n] == b[: 4 * n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint32, n) != np.frombuffer(b, np.uint32, n)))


Suffix = tuple[int, int, bytes, bytes]


def _starts(sides: list[bytes], words: int) -> np.ndarray:
    """Hashes of the first 0 to ``words`` 4-byte values of each side; beyond its end they are unlike any other row's."""
    size = np.array([len(x) // 4 for x in sides])
    value = np.frombuffer(b"".join(x[: 4 * words].ljust(4 * words, b"\0") for x in sides), np.uint32).reshape(len(sides), words)
    out = np.zeros((len(sides), words + 1), np.uint64)
    for k in range(words):
        out[:, k + 1] = mix64(out[:, k] ^ value[:, k])
    out[np.arange(words + 1) > size[:, None]] = 0
    return out


def _counted(rows: list[Suffix], repeats: Repeats) -> list[tuple[int, int, int]]:
    """Spans of the windows of ``least`` words that two suffixes of one prefix have around them."""
    ahead, most = repeats.least - repeats.prefix, repeats.window - 1
    sides = [[_starts([x[c] for x in rows[i : i + repeats.block]], k) for i in range(0, len(rows), repeats.block)] for c, k in ((2, ahead), (3, most))]
    right, left = (np.concatenate(x) for x in sides)
    room = [np.array([len(x[c]) // 4 for x in rows]) for c in (2, 3)]
    low, high = np.full(len(rows), most + 1), np.full(len(rows), -1)
    for s in range(min(most, ahead) + 1):
        whole = np.flatnonzero((room[0] >= ahead - s) & (room[1] >= s))
        _, which, n = np.unique(mix64(left[whole, s]) ^ right[whole, ahead - s], return_inverse=True, return_counts=True)
        twice = whole[n[which] > 1]
        low[twice], high[twice] = np.minimum(low[twice], s), s
    return [(rows[i][0], rows[i][1] - int(high[i]), rows[i][1] - int(low[i]) + repeats.least) for i in np.flatnonzero(high >= 0)]


def compare_block(rows: list[Suffix], repeats: Repeats) -> list[tuple[int, int, int]]:
    """Spans (node, start, end) of repeats among suffixes (node, at, right, left) of one prefix."""
    rows = list(dict.fromkeys(rows))
    n = len(rows)
    if n < 2:
        return []
    if n > repeats.pairs:
        return _counted(rows, repeats)
    best: dict[int, list[int]] = {}
    for i, j in ((i, j) for i in range(n) for j in range(i)):
        r, s = repeats.prefix + _shared(rows[i][2], rows[j][2]), _shared(rows[i][3], rows[j][3])
        if r + s >= repeats.least:
            for x in (i, j):
                now = best.setdefault(x, [0, 0])
                now[0], now[1] = max(now[0], s), max(now[1], r)
    return [(rows[i][0], rows[i][1] - s, rows[i][1] + r) for i, (s, r) in best.items()]


def _compare(repeats: Repeats):
    """Streams suffixes in the order of prefix, node and position; holds one prefix, each suffix once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[Suffix] = []
        prefix, out = None, []

        def result() -> pa.RecordBatch:
            columns = list(zip(*out)) or [(), (), ()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], names=["node", "start", "end"])

        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("prefix", "node", "at", "right", "left")]):
                if row[0] != prefix:
                    out += compare_block(block, repeats)
                    prefix, block = row[0], []
                if not block or block[-1] != row[1:]:  # equal rows of the input give equal suffixes
                    block.append(row[1:])
            if out:
                yield result()
        out += compare_block(block, repeats)
        yield result()

    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return merged


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = [merge_spans([(s["start"], s["end"]) for s in spans]) for spans in batch.column("spans").to_pylist()]
        columns = [batch.column("node"), pa.array([sum(e - s for s, e in x) for x in lists], pa.int64()), pa.array([",".join(f"{s}:{e}" for s, e in x) for x in lists])]
        yield pa.RecordBatch.from_arrays(columns, names=["node", "found_words", "found"])


def repeated_passages(docs: DataFrame, repeats: Repeats | None = None) -> DataFrame:
    """Documents with repeated passages: doc_id, n_words, n_repeated words and spans of words.

    ``spans`` lists ``start:end``, end exclusive, in words counted from 0 and parted by commas.
    """
    repeats = repeats or Repeats()
    positions = _positions(docs, repeats)
    nodes = positions.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"), F.first("n_words").alias("n_words"), F.first("prefixes").alias("prefixes"), F.first("places").alias("places"))
    nodes = written(nodes, "suffix-nodes")
    suffixes = nodes.select("node", "prefixes", "places").mapInArrow(_exploded, "prefix bigint, node bigint, at int")
    shared = written(suffixes.groupBy("prefix").agg(F.count("*").alias("n")), "prefix-counts")
    total = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = shared.where("n > 1").withColumn("hot", F.col("n") > repeats.hot)
    kept = join_spread(suffixes, many, "prefix", total).groupBy("node").agg(F.collect_list(F.struct("at", "hot")).alias("at"))
    kept = kept.join(nodes.select("node", "doc_id"), "node").select(F.col("node").alias("__own"), F.col("doc_id").alias("__id"), "at")

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 8 << 20):
            yield batch.append_column("node", pa.array([_node(t) for t in raw_texts(batch.column("text"))], pa.int64()))

    texts = only(docs, "doc_id", "text")
    texts = texts.mapInArrow(identify, T.StructType([*texts.schema, T.StructField("node", T.LongType())]))
    right = kept.hint("shuffle_hash")
    content = texts.join(right, texts["doc_id"].eqNullSafe(right["__id"]) & (texts["node"] == right["__own"])).select("text", "node", "at")
    carried = content.mapInArrow(_contexts(repeats), "prefix bigint, node bigint, at int, hot boolean, right binary, left binary")
    any_hot = not many.where("hot").isEmpty()
    if any_hot:
        carried = written(carried, "suffixes")
    ordered = carried.where("NOT hot").drop("hot").repartition("prefix").sortWithinPartitions("prefix", "node", "at")
    spans = ordered.mapInArrow(_compare(repeats), "node bigint, start int, end int")
    if any_hot:
        windows = carried.where("hot").drop("hot").mapInArrow(_windows(repeats), "window bigint, node bigint, start int").distinct()
        windows = written(windows, "hot-windows")
        twice = windows.groupBy("window").agg(F.count("*").alias("n")).where("n > 1")
        found = join_spread(windows, twice, "window", windows.count()).select("node", "start", (F.col("start") + repeats.least).alias("end"))
        spans = spans.union(found.distinct())
    merged = spans.groupBy("node").agg(F.collect_list(F.struct("start", "end")).alias("spans")).mapInArrow(_merged, "node bigint, found_words bigint, found string")
    known = nodes.select("node", "n", "n_words").join(merged, "node", "left")
    copied = (F.col("n") > 1) & (F.col("n_words") >= repeats.least)
    known = known.where(copied | F.col("found").isNotNull()).select(
        "node", "n", "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.col("found_words")).alias("n_repeated"),
        F.when(copied, F.concat(F.lit("0:"), "n_words")).otherwise(F.col("found")).alias("spans"),
    )
    known = written(known, "node-repeats")
    rows = positions.select("doc_id", "node")
    return join_spread(rows, known, "node", rows.count()).select("doc_id", "n_words", "n_repeated", "spans")
