"""n-gram overlap and longest shared runs against a reference."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.sources.tables import read_back, read_saved, saved, saved_path

#: Runs of the smaller side that a task holds, about 100 MB; beyond them both sides are shuffled.
RUNS = 1 << 22
#: Elements of the larger side that a task looks at in one step.
STEP = 1 << 18


def grams(seq: Column, n: int, text: bool) -> Column:
    """All n-grams of a string (by characters) or of an array, as an array; empty if too short."""
    if n <= 0:
        raise ValueError("n must be positive")
    size = F.length(seq) if text else F.size(seq)
    at = F.sequence(F.lit(1), size - n + 1)
    piece = (lambda i: F.substring(seq, i, F.lit(n))) if text else (lambda i: F.slice(seq, i, F.lit(n)))
    return F.when(size >= n, F.transform(at, piece))


def _hashed(seq: str, n: Column | int, text: bool) -> Column:
    """The distinct 64-bit hashes of all n-grams; NULL where there are none.

    The sequence is bound once: an expression behind its name would be computed again per n-gram.
    """
    n = F.lit(n) if isinstance(n, int) else n

    def hashes(s: Column) -> Column:
        size = F.length(s) if text else F.size(s)
        piece = (lambda i: F.substring(s, i, n)) if text else (lambda i: F.slice(s, i, n))
        return F.when(size >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.xxhash64(piece(i)))))

    return F.transform(F.array(seq), hashes)[0]


def ngram_overlap(candidates: DataFrame, reference: DataFrame, n: int, seq: str = "seq", name: str = "name", text: bool = True) -> DataFrame:
    """name and ``overlap``: the share of a candidate's distinct n-grams that the reference has.

    NULL for a candidate shorter than n; names are unique. n-grams are compared by 64-bit hashes. Where
    one side is small, tasks hold its n-grams and the other side is scanned once (:func:`_shared`).
    """
    if n <= 0:
        raise ValueError("n must be positive")
    found = _shared(candidates, reference, [n], 0, seq, name, text)
    if found is None:
        return _shuffled_overlap(candidates, reference, n, seq, name, text)
    return found.select("name", _overlap(n).alias("overlap"))


def _overlap(n: int) -> Column:
    return F.when(F.col(f"n{n}") > 0, F.col(f"h{n}") / F.col(f"n{n}"))


def _shuffled_overlap(candidates: DataFrame, reference: DataFrame, n: int, seq: str, name: str, text: bool) -> DataFrame:
    """:func:`ngram_overlap` of two large sides: both are shuffled by hash."""
    own = candidates.select(F.col(name).alias("name"), _hashed(seq, n, text).alias("h"))
    ref = saved(reference.select(F.explode(_hashed(seq, n, text)).alias("g")).distinct(), "reference-grams")
    hits = own.select("name", F.explode("h").alias("g")).join(ref, "g", "left_semi").groupBy("name").agg(F.count("*").alias("hits"))
    sized = own.select("name", F.size("h").alias("n"), F.col("h").isNotNull().alias("long"))
    return sized.join(hits, "name", "left").select("name", F.when(F.col("long"), F.coalesce("hits", F.lit(0)) / F.col("n")).alias("overlap"))


# == one side small ==


class _Rows:
    """Sequences end to end: hashes of their runs and how many elements are left at each place.

    A run's hash is a difference of prefix sums of codes times powers of an odd number, shifted back by
    a power of its inverse, so every length costs one subtraction.
    """

    ODD = 0xD6E8FEB86659FD93

    def __init__(self, codes: np.ndarray, sizes: np.ndarray):
        size, self.sizes = len(codes), sizes
        ends = np.cumsum(sizes)
        self.starts, self.left = ends - sizes, (np.repeat(ends, sizes) - np.arange(size)).astype(np.int32)
        with np.errstate(over="ignore"):
            inverse = np.uint64(pow(self.ODD, -1, 1 << 64))
            power = np.cumprod(np.full(size, self.ODD, np.uint64)) * inverse
            self.back = np.cumprod(np.full(size, inverse)) * np.uint64(self.ODD)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * power)])

    def grams(self, at: np.ndarray, n) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[at + n] - self.sums[at]) * self.back[at]


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 well mixed bits of different numbers."""
    with np.errstate(over="ignore"):
        z = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _flat(column: pa.Array | pa.ChunkedArray, text: bool) -> tuple[pa.Array, np.ndarray]:
    """All elements and how many each row has; NULL has none."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not text:
        return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    points = [np.frombuffer((s or "").encode("utf-32-le", "surrogatepass"), np.uint32) for s in column.to_pylist()]
    return pa.array(np.concatenate([np.zeros(0, np.uint32), *points])), np.array([len(x) for x in points], np.int64)


class _Runs:
    """All runs of the smaller side, of lengths 1 to ``top`` or of one length, as sorted 64-bit keys."""

    def __init__(self, column: pa.ChunkedArray, lengths: Sequence[int], text: bool):
        values, sizes = _flat(column, text)
        self.words = values.unique()
        self.ids = pc.index_in(values, value_set=self.words).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = _Rows(_mixed(self.ids), sizes)
        self.lengths = [n for n in lengths if n <= sizes.max(initial=0)]
        self.salt = _mixed(np.arange(1 << 40, (1 << 40) + max(self.lengths, default=0) + 1))
        keys, places, ns = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for n in self.lengths:
            at = np.flatnonzero(rows.left >= n)
            own, first = np.unique(rows.grams(at, n) ^ self.salt[n], return_index=True)
            keys.append(own), places.append(at[first].astype(np.int32)), ns.append(np.full(len(own), n, np.int32))
        every = np.concatenate(keys)
        order = np.argsort(every)
        self.keys, self.place, self.n, self.row_left = every[order], np.concatenate(places)[order], np.concatenate(ns)[order], rows.left
        bits = max(16, int(8 * len(every) + 1).bit_length())
        self.mask, self.maybe = np.uint64((1 << bits) - 1), np.zeros(1 << bits, bool)
        self.maybe[self.keys & self.mask] = True

    def codes(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Codes of a batch's elements, and which of them are elements of this side."""
        own = values.dictionary_encode(null_encoding="encode")
        known = pc.fill_null(pc.index_in(own.dictionary, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        of = _mixed(np.where(known >= 0, known, np.arange(len(known)) + (1 << 32)))
        at = own.indices.to_numpy(zero_copy_only=False)
        return of[at], (known >= 0)[at]

    def find(self, rows: _Rows, at: np.ndarray, n) -> np.ndarray:
        """The number of the run of n elements from each place, -1 where this side has none."""
        key = rows.grams(at, n) ^ self.salt[n]
        out = np.full(len(at), -1, np.int64)
        some = np.flatnonzero(self.maybe[key & self.mask])
        spot = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
        fit = self.keys[spot] == key[some]
        out[some[fit]] = spot[fit]
        return out

    def longest(self, rows: _Rows, known: np.ndarray) -> np.ndarray:
        """How long a run of this side begins at each place: lengths double while they are found, then are halved."""
        limit = np.minimum(rows.left, len(self.lengths))
        m = (known & (limit > 0)).astype(np.int32)
        at, step = np.flatnonzero(m), 1
        while at.size:
            fits = limit[at] >= 2 * step
            more = np.zeros(len(at), bool)
            if fits.any():
                more[fits] = self.find(rows, at[fits], 2 * step) >= 0
            m[at[more]], rest, half = 2 * step, at[~more], step // 2
            while half and rest.size:
                want = m[rest] + half
                ask = np.flatnonzero(want <= limit[rest])
                hit = ask[self.find(rows, rest[ask], want[ask]) >= 0]
                m[rest[hit]] += half
                half //= 2
            at, step = at[more], 2 * step
        return m


_held: dict[tuple, _Runs] = {}


def _held_runs(path: str, lengths: Sequence[int], text: bool) -> _Runs:
    """The runs of a written table; a worker keeps those of the last one for its next tasks."""
    key = (path, tuple(lengths), text)
    if key not in _held:
        _held.clear()
        _held[key] = _Runs(read_saved(path, ["seq"]).column("seq"), lengths, text)
    return _held[key]


def _steps(batches: Iterator[pa.RecordBatch], runs: _Runs, text: bool) -> Iterator[tuple[pa.RecordBatch, _Rows, np.ndarray]]:
    """Slices of about STEP elements, with their rows and known elements."""
    for batch in batches:
        values, sizes = _flat(batch.column("seq"), text)
        codes, known = runs.codes(values)
        ends, lo = np.cumsum(sizes), 0
        while lo < len(sizes):
            base = int(ends[lo] - sizes[lo])
            hi = max(lo + 1, int(np.searchsorted(ends, base + STEP, side="right")))
            end = int(ends[hi - 1])
            yield batch.slice(lo, hi - lo), _Rows(codes[base:end], sizes[lo:hi]), known[base:end]
            lo = hi


def _distinct(x: np.ndarray) -> int:
    x = np.sort(x)
    return int(np.count_nonzero(x[1:] != x[:-1])) + bool(len(x))


def _against(candidates: DataFrame, path: str, ns: Sequence[int], top: int, text: bool) -> DataFrame:
    """name, for each n the number of distinct n-grams and of those found, and the longest match, against written runs."""
    kind, lengths = candidates.schema["name"].dataType.simpleString(), range(1, top + 1) if top else list(ns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _held_runs(path, lengths, text)
        for batch, rows, known in _steps(batches, runs, text):
            longest, out = runs.longest(rows, known) if top else None, [batch.column("name")]
            for n in ns:
                at = np.flatnonzero(rows.left >= n)
                hit = runs.find(rows, at, n) >= 0 if n in runs.lengths else np.zeros(len(at), bool)
                grams, count, hits = rows.grams(at, n), np.maximum(rows.sizes - n + 1, 0), at[hit]
                ends, froms = np.cumsum(count), np.searchsorted(hits, rows.starts)
                tos, found = np.append(froms[1:], len(hits)), rows.grams(hits, n)
                out.append(pa.array([_distinct(grams[b - c : b]) for b, c in zip(ends, count)], pa.int64()))
                out.append(pa.array([_distinct(found[a:b]) if b > a else 0 for a, b in zip(froms, tos)], pa.int64()))
            best = np.zeros(batch.num_rows, np.int32)
            if top and len(longest):
                full = rows.sizes > 0
                best[full] = np.maximum.reduceat(longest, rows.starts[full])
            yield pa.RecordBatch.from_arrays([*out, pa.array(best)], names=["name", *(f"{x}{n}" for n in ns for x in "nh"), "longest"])

    return candidates.select("name", "seq").mapInArrow(run, f"name {kind}, {''.join(f'n{n} bigint, h{n} bigint, ' for n in ns)}longest int")


def _found_runs(reference: DataFrame, path: str, ns: Sequence[int], top: int, text: bool) -> DataFrame:
    """seq: the greatest of the written runs that rows of the reference have, at most one per place and task."""
    kind, lengths = reference.schema["seq"].dataType.simpleString(), range(1, top + 1) if top else list(ns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = _held_runs(path, lengths, text)
        seen = np.zeros(len(runs.keys), bool)
        for _, rows, known in _steps(batches, runs, text):
            for n in runs.lengths if not top else [0]:
                m = runs.longest(rows, known) if top else np.where(rows.left >= n, n, 0)
                at = np.flatnonzero(m)
                spot = runs.find(rows, at, m[at])
                seen[spot[spot >= 0]] = True
        great = np.zeros(len(runs.ids) + 1, np.int32)
        np.maximum.at(great, runs.place[seen], runs.n[seen])
        inside = np.zeros(len(great), bool)
        inside[1:] = (great[1:] > 0) & (great[:-1] > great[1:])  # the run one place before ends there too
        for lo in range(0, len(great), 1 << 14):
            at = lo + np.flatnonzero((great > 0)[lo : lo + (1 << 14)] & ~inside[lo : lo + (1 << 14)])
            if at.size:
                size = great[at].astype(np.int64)
                ids = runs.ids[np.repeat(at, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)]
                values, offsets = runs.words.take(pa.array(ids)), np.concatenate([[0], np.cumsum(size)])
                if text:
                    points = values.to_numpy(zero_copy_only=False)
                    column = pa.array([points[a:b].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(offsets, offsets[1:])], pa.string())
                else:
                    column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
                yield pa.RecordBatch.from_arrays([column], names=["seq"])

    return reference.select("seq").mapInArrow(run, f"seq {kind}").distinct()


def _runs_in(df: DataFrame, ns: Sequence[int], top: int, text: bool) -> int:
    """How many runs a task would hold of ``df``, elements included."""
    size = F.coalesce((F.length("seq") if text else F.size("seq")).cast("double"), F.lit(0.0))
    short = F.least(size, F.lit(float(top)))
    runs = size * short - short * (short - 1) / 2 if top else sum((F.greatest(size - n + 1, F.lit(0.0)) for n in ns), F.lit(0.0))
    return int(df.agg(F.sum(F.greatest(size, runs))).first()[0] or 0)


def _shared(candidates: DataFrame, reference: DataFrame, ns: Sequence[int], top: int, seq: str, name: str, text: bool) -> DataFrame | None:
    """Per candidate and n: distinct n-grams, those that the reference has; and the longest match up to ``top``.

    The smaller side is written; tasks hold its runs and scan the other side once, with nothing shuffled. If
    the candidates are the smaller side, what is found of their runs takes the place of the reference. None
    where both sides have more runs than a task may hold.
    """
    own, ref = candidates.select(F.col(name).alias("name"), F.col(seq).alias("seq")), reference.select(F.col(seq).alias("seq"))
    sides = sorted([(reference.count(), 1, ref), (candidates.count(), 0, own)], key=lambda x: x[:2])
    for rows, is_reference, small in sides:
        if rows > RUNS:
            continue
        path = saved_path(small, "smaller-side")
        if _runs_in(read_back(small, path), ns, top, text) > RUNS:
            continue
        if is_reference:
            return _against(own, path, ns, top, text)
        return _against(read_back(small, path), saved_path(_found_runs(ref, path, ns, top, text), "found-runs"), ns, top, text)
    return None


def longest_match(candidates: DataFrame, reference: DataFrame, max_n: int = 64, seq: str = "seq", name: str = "name", text: bool = True) -> DataFrame:
    """name, ``longest_match`` up to ``max_n`` and whether the cap was reached.

    Where one side is small, tasks hold its runs of all lengths and the other side is scanned once
    (:func:`_shared`).
    """
    found = _shared(candidates, reference, [], max_n, seq, name, text)
    if found is None:
        return _shuffled_longest(candidates, reference, max_n, seq, name, text)
    return found.select("name", F.col("longest").alias("longest_match"), (F.col("longest") >= max_n).alias("capped"))


def _shuffled_longest(candidates: DataFrame, reference: DataFrame, max_n: int, seq: str, name: str, text: bool) -> DataFrame:
    """:func:`longest_match` of two large sides.

    A shared run of n has shared runs of every shorter length, so each candidate's length is found
    by binary search; all candidates advance together, in log2(max_n) rounds of semi joins. All start
    from one interval, so a round asks for few lengths, and of the reference only runs that a candidate
    has are kept before anything is shuffled, while those of the candidates are under Spark's threshold.
    """
    whole = saved(reference.select(_codes(seq, text).alias("codes")).where(F.size("codes") > 0), "reference-codes")
    state = candidates.select(F.col(name).alias("name"), _codes(seq, text).alias("codes"), F.lit(0).alias("lo"), F.lit((1 << max_n.bit_length()) - 1).alias("hi"))
    state = saved(state, "longest")
    for _ in range(max_n.bit_length()):
        state = state.withColumn("mid", F.floor((F.col("lo") + F.col("hi") + 1) / 2).cast("int"))
        mine = saved(_runs_of(state.where("lo < hi").select("name", "codes", F.array("mid").alias("lengths")), ["name"]), "candidate-runs")
        lengths = [r["mid"] for r in state.where("lo < hi").select("mid").distinct().collect()]  # at most max_n numbers
        theirs = _runs_of(whole.withColumn("lengths", F.array(*[F.lit(n) for n in lengths]).cast("array<int>")), [])
        theirs = saved(theirs.join(saved(mine.select("n", "g").distinct(), "asked-runs"), ["n", "g"], "left_semi").distinct(), "reference-runs")
        hit = mine.join(theirs, ["n", "g"], "left_semi").select("name").distinct().withColumn("hit", F.lit(True))
        state = state.join(hit, "name", "left")
        yes, open_ = F.coalesce("hit", F.lit(False)), F.col("lo") < F.col("hi")
        state = saved(state.select("name", "codes", F.when(open_ & yes, F.col("mid")).otherwise(F.col("lo")).alias("lo"), F.when(open_ & ~yes, F.col("mid") - 1).otherwise(F.col("hi")).alias("hi")), "longest")
    return state.select("name", F.least("lo", F.lit(max_n)).alias("longest_match"), (F.col("lo") >= max_n).alias("capped"))


def _codes(seq: str, text: bool) -> Column:
    """A 64-bit hash per element, or per character of a string; NULL and empty sequences have none."""
    if not text:
        return F.transform(seq, lambda x: F.xxhash64(x))
    return F.transform(F.when(F.length(seq) > 0, F.sequence(F.lit(1), F.length(seq))), lambda i: F.xxhash64(F.substring(F.col(seq), i, F.lit(1))))


def _runs_of(df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """keep, n and the distinct hashes g of a row's runs of n codes, for each n in ``lengths``.

    A run's hash is a difference of prefix sums of codes times powers of an odd number, shifted back
    by a power of its inverse, so every length costs one pass over the codes.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd, inverse, mask = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64), (1 << 64) - 1
        for batch in batches:
            for i in range(batch.num_rows):
                codes, lengths = batch.column("codes")[i].values, batch.column("lengths")[i].as_py()
                if codes is None or not len(codes) or not lengths:
                    continue
                value = codes.to_numpy(zero_copy_only=False).view(np.uint64)
                with np.errstate(over="ignore"):
                    power = np.cumprod(np.full(len(value), odd, np.uint64)) * np.uint64(inverse & mask)  # odd ** i
                    back = np.cumprod(np.full(len(value), inverse, np.uint64)) * np.uint64(odd)  # inverse ** i
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power)])
                    found = [np.unique((sums[n:] - sums[:-n]) * back[: len(value) - n + 1]) for n in lengths if 0 < n <= len(value)]
                if found:
                    sizes = [len(f) for f in found]
                    fit = [n for n in lengths if 0 < n <= len(value)]
                    own = [pa.repeat(batch.column(c)[i], sum(sizes)) for c in keep]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(np.repeat(np.array(fit, np.int32), sizes)), pa.array(np.concatenate(found).view(np.int64))], names=[*keep, "n", "g"])

    head = "".join(f"`{c}` {kinds[c]}, " for c in keep)
    return df.select(*keep, "codes", "lengths").mapInArrow(run, f"{head}n int, g bigint")


def contamination_report(candidates: DataFrame, reference: DataFrame, control: DataFrame | None = None, ns: Sequence[int] = (8, 16), max_n: int = 64, seq: str = "seq", name: str = "name", text: bool = True) -> DataFrame:
    """Overlaps and longest match per candidate, and what exceeds the control's row.

    ``control`` is one row with ``seq``; the name ``control`` is reserved for it.
    """
    named = candidates.select(F.when(F.col(name) == "control", F.raise_error(F.lit("the name control is reserved"))).otherwise(F.col(name)).alias("name"), F.col(seq).alias("seq"))
    if control is not None:
        named = named.union(control.select(F.lit("control"), F.col(seq)))
    ref = reference.select(F.col(seq).alias("seq"))
    out = named.select("name", (F.length("seq") if text else F.size("seq")).alias("length"), (F.col("name") == "control").alias("is_control"))
    top = max([max_n, *ns])
    found = _shared(named, ref, list(ns), top, "seq", "name", text)
    if found is None:
        for n in ns:
            out = out.join(_shuffled_overlap(named, ref, n, "seq", "name", text).withColumnRenamed("overlap", f"overlap_{n}"), "name", "left")
        out = out.join(_shuffled_longest(named, ref, max_n, "seq", "name", text), "name", "left")
    else:
        longest = F.least("longest", F.lit(max_n))
        own = found.select("name", *[_overlap(n).alias(f"overlap_{n}") for n in ns], longest.alias("longest_match"), (longest >= max_n).alias("capped"))
        out = out.join(own, "name", "left")
    if control is not None:
        columns = [*(f"overlap_{n}" for n in ns), "longest_match"]
        base = out.where("is_control").select(*[F.col(c).alias(f"_{c}") for c in columns])
        out = out.crossJoin(F.broadcast(base))  # one row
        out = out.select(*[c for c in out.columns if not c.startswith("_")], *[(F.col(c) - F.col(f"_{c}")).alias(f"{c}_excess") for c in columns])
    return out
