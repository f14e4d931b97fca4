"""Packing by cutting-stock column generation.

Documents are tokenised and cut into pieces of the sequence length with one rest each. Lengths are
counted in a histogram of a fixed number of bins. On the driver, a linear program over patterns
(bin counts that fit a sequence) is solved by column generation: the duals of the basis price the
bins and an unbounded knapsack by dynamic programming finds the best new pattern. Patterns are
rounded down; what remains is packed best fit decreasing. The plan has a size bounded by the number
of bins, whatever the input. Pieces are ranked within their bin by counts per partition and take
the slots of the patterns in that order, so no bin is ever sorted in one task.

Defined results: a null text is empty; an empty text still has its end id; ids follow the named
tokenizer with the texts of special tokens read as its library does by default; repeated rows and
null ids are documents of their own; extra columns are ignored.
"""

from __future__ import annotations

import array
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import only, sliced, written

END = 0


#: The splitting pattern of byte-level BPE, and the same without its look-ahead.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LINEAR = PATTERN.replace(r"\s+(?!\S)|", "")
PROBE = "It's 12  of\n\n\tstra\u00dfe, \u00e9t\u00e9s!! \u4f60 \n x's"


class Tokens:
    """Token ids of texts under a tokenizer file, with a faster way for byte-level BPE.

    Where the file is plain byte-level BPE, its vocabulary also serves as merge ranks of the other
    library; a probe decides. The look-ahead of the splitting pattern matters only where two
    white-space characters touch, so texts without such a place are split without it. Texts that
    hold the string of a special token go to the file's own tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.full = self.linear = None
        ranks = self._ranks(path)
        if ranks:
            import tiktoken

            made = [tiktoken.Encoding(n, pat_str=p, mergeable_ranks=ranks, special_tokens={}) for n, p in (("full", PATTERN), ("linear", LINEAR))]
            if made[0].encode_ordinary(PROBE) == self._own(PROBE):
                self.full, self.linear = (e._core_bpe.encode_ordinary for e in made)

    @staticmethod
    def _ranks(path: str) -> dict[bytes, int] | None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"].get("type") != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        code = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        added = {t["content"] for t in spec.get("added_tokens", [])}
        return {bytes(code[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}

    def _own(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _touching(raw: bytes) -> bool:
        """Whether two white-space characters may touch; any rare one counts as if they did."""
        return (
            b"  " in raw or b"\n\n" in raw or b" \n" in raw or b"\n " in raw
            or any(x in raw for x in (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a", b"\xe2\x80", b"\xe2\x81", b"\xe3\x80"))
            or len(raw.translate(None, b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f")) < len(raw)
        )

    def ids(self, text: str) -> list[int]:
        raw = text.encode()
        if self.full is None or any(s in raw for s in self.special):
            return self._own(text)
        return self.full(text) if self._touching(raw) else self.linear(text)


def _knapsack(value: np.ndarray, widths: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The best pattern for bin values: unbounded knapsack over capacities by dynamic programming."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(int(widths[0]), room + 1):
        n = int(np.searchsorted(widths, c, "right"))
        gain = best[c - widths[:n]] + value[:n]
        j = int(np.argmax(gain))
        if gain[j] > best[c - 1]:
            best[c], took[c] = gain[j], j
        else:
            best[c] = best[c - 1]
    pattern, c = np.zeros(len(widths)), room
    while c >= widths[0]:
        if took[c] < 0:
            c -= 1
            continue
        pattern[took[c]] += 1
        c -= int(widths[took[c]])
    return float(best[room]), pattern


def _image(inverse: np.ndarray, vector: np.ndarray) -> np.ndarray:
    """inverse times vector over the vector's few entries, without threads of a linear algebra library."""
    at = np.flatnonzero(vector)
    return (inverse[:, at] * vector[at]).sum(axis=1)


def _enter(inverse: np.ndarray, step: np.ndarray, out: int) -> None:
    """Update the inverse of a basis in place: the column whose image is ``step`` replaces column ``out``."""
    inverse[out] /= step[out]
    others = np.arange(len(step)) != out
    inverse[others] -= np.outer(step[others], inverse[out])


def _first_basis(widths: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """A triangular basis and its inverse: the widest bin left is filled up as well as bins left allow, until one is used up."""
    left, columns, done = demand.astype(float).copy(), [], []
    while (live := np.flatnonzero(left > 0)).size:
        value = (widths[live] / room) ** 1.02
        rest = room - int(widths[live[-1]])
        pattern = np.zeros(len(widths))
        if rest >= widths[live[0]]:
            pattern[live] = _knapsack(value, widths[live], rest)[1]
        pattern[live[-1]] += 1
        used = np.flatnonzero(pattern)
        ratio = left[used] / pattern[used]
        out = int(used[np.argmin(ratio)])
        left -= ratio.min() * pattern
        left[out] = 0
        left[left < 1e-9] = 0
        columns.append(pattern)
        done.append(out)
        for j in np.flatnonzero((left == 0) & (demand > 0)):
            if j not in done:
                alone = np.zeros(len(widths))
                alone[j] = room // widths[j]
                columns.append(alone)
                done.append(int(j))
    basis, inverse = np.empty((len(widths), len(widths))), np.eye(len(widths))
    basis[:, done] = np.array(columns).T
    for out, pattern in zip(reversed(done), reversed(columns)):  # each holds bins that were used up later only
        _enter(inverse, _image(inverse, pattern), out)
    return basis, inverse


def solve_patterns(widths: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3, rounds: int = 4000) -> list[tuple[np.ndarray, float]]:
    """The linear program of cutting stock by column generation: patterns with fractional use.

    A revised simplex keeps the inverse of the basis. Prices are drawn towards the duals of the best
    bound so far, at first the share of a sequence that a length takes, which spares most pivots.
    It ends when no pattern prices out, when the value is within ``gap`` of the bound, or after
    ``rounds`` pivots; the last basis is feasible in each case.
    """
    m = len(widths)
    columns, inverse = _first_basis(widths, demand, room)
    use = np.maximum(_image(inverse, demand), 0)
    centre = widths / room
    bound = float(centre @ demand)
    for _ in range(rounds):
        if use.sum() <= (1 + gap) * bound:
            break
        dual = inverse.sum(axis=0)
        for weight in (0.9, 0.5, 0.0):
            priced = np.maximum(weight * centre + (1 - weight) * dual, 0)
            best, pattern = _knapsack(priced, widths, room)
            if best > 1e-12 and priced @ demand / best > bound:
                bound, centre = float(priced @ demand / best), priced / best
            if dual @ pattern > 1 + 1e-9:
                break
        else:
            break
        step = _image(inverse, pattern)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(step > 1e-9, use / step, np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        _enter(inverse, step, out)
        columns[:, out] = pattern
        use = np.maximum(_image(inverse, demand), 0)
    return [(columns[:, j], float(use[j])) for j in range(m) if use[j] > 0]


def plan_sequences(widths: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3) -> list[tuple[dict[int, int], int]]:
    """Whole patterns that cover each bin's demand exactly: (bin index -> count, repetitions)."""
    left, plan = demand.astype(np.int64).copy(), []
    if not left.sum():
        return plan
    for pattern, use in sorted(solve_patterns(widths, demand.astype(float), room, gap), key=lambda p: -p[1]):
        need = pattern.astype(np.int64)
        used = need > 0
        times = min(int(use + 1e-6), int((left[used] // need[used]).min()))
        if times > 0:
            plan.append(({int(j): int(need[j]) for j in np.flatnonzero(used)}, times))
            left -= times * need
    spaces: list[list[dict[int, int]]] = [[] for _ in range(room + 1)]
    for j in np.argsort(-widths):
        w = int(widths[j])
        for _ in range(int(left[j])):
            free = next((s for s in range(w, room + 1) if spaces[s]), room)
            bag = spaces[free].pop() if spaces[free] else {}
            bag[int(j)] = bag.get(int(j), 0) + 1
            spaces[free - w].append(bag)
    return plan + [(bag, 1) for bags in spaces for bag in bags]


@dataclass(frozen=True)
class Packing:
    """``length`` ids a sequence; lengths are planned in steps of ``unit`` ids."""

    length: int = 1024
    unit: int = 4
    gap: float = 1e-3

    @property
    def room(self) -> int:
        return self.length // self.unit


def cut_pieces(docs: DataFrame, tokenizer: str, packing: Packing, slice_bytes: int = 4 << 20) -> DataFrame:
    """Tokenise and cut: one row per piece, with its bin and its number in (partition, bin)."""
    kind = only(docs, "doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = Tokens(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(packing.room + 1, np.int64)
        for batch in sliced(batches, "text", slice_bytes):
            row, start, length, crc, total, bins, rank = ([] for _ in range(7))
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = array.array("I", tokens.ids(text) if text else ())
                ids.append(END)
                raw, n = memoryview(ids).cast("B"), len(ids)
                for s in range(0, n, packing.length):
                    size = min(packing.length, n - s)
                    b = -(-size // packing.unit)
                    row.append(i), start.append(s), length.append(size), total.append(n), bins.append(b), rank.append(int(seen[b]))
                    crc.append(zlib.crc32(raw[4 * s : 4 * (s + size)]))
                    seen[b] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row, pa.int32())), *[pa.array(x, pa.int64()) for x in (start, length, crc, total)], pa.array(bins, pa.int32()), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "part", "rank"],
            )

    schema = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, bin int, part int, rank bigint"
    return only(docs, "doc_id", "text").mapInArrow(run, schema)


def pack(docs: DataFrame, tokenizer: str, packing: Packing | None = None) -> DataFrame:
    """One row per piece with its sequence and its offset in it."""
    packing = packing or Packing()
    pieces = written(cut_pieces(docs, tokenizer, packing), "pieces")
    per = pieces.groupBy("bin", "part").agg(F.count("*").alias("n"))
    demand = np.zeros(packing.room + 1, np.int64)
    for r in per.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # at most `room` rows
        demand[r["bin"]] = r["n"]
    whole = int(demand[packing.room])
    widths = np.flatnonzero(demand[: packing.room])
    plan = plan_sequences(widths, demand[widths], packing.room, packing.gap)
    until: list[list[int]] = [[] for _ in range(packing.room + 1)]
    first: list[list[int]] = [[] for _ in range(packing.room + 1)]
    count: list[list[int]] = [[] for _ in range(packing.room + 1)]
    until[packing.room], first[packing.room], count[packing.room] = [whole], [0], [1]
    at = whole
    for bag, times in plan:
        for j, n in bag.items():
            b = int(widths[j])
            until[b].append((until[b][-1] if until[b] else 0) + n * times)
            first[b].append(at)
            count[b].append(n)
        at += times
    slots = [tuple(np.array(x[b], np.int64) for x in (until, first, count)) for b in range(packing.room + 1)]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, rank = (np.asarray(batch.column(c)) for c in ("bin", "place"))
            sequence = np.empty(len(bins), np.int64)
            for b in np.unique(bins):
                ends, starts, n = slots[b]
                mine = bins == b
                p = np.searchsorted(ends, rank[mine], "right")
                sequence[mine] = starts[p] + (rank[mine] - np.where(p > 0, ends[p - 1], 0)) // n[p]
            yield batch.append_column("sequence_id", pa.array(sequence))

    before = Window.partitionBy("bin").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = per.select("bin", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    placed = pieces.join(base, ["bin", "part"]).withColumn("place", F.col("base") + F.col("rank"))
    placed = placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bin", "place")
    placed = placed.mapInArrow(place, T.StructType([*placed.schema, T.StructField("sequence_id", T.LongType())]))
    within = Window.partitionBy("sequence_id").orderBy(F.desc("bin"), "place")
    offset = F.sum("length").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("length")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))
