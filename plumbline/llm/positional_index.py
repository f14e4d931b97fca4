"""Benchmark decontamination with a distributed positional inverted index.

The corpus is cut into segments of a few megabytes. For each segment the terms and, per term, the
ascending positions of all its occurrences are stored as one row of a table in the shared folder;
building it shuffles nothing. Test items are cut into words and windows once and written as arrays,
each window with its terms from the rarest to the most frequent among the items. A search reads the
index segment by segment: windows with a term that the segment lacks go, rare terms first; the others
start from the list of their rarest term in that segment, shift it by the term's offset in the window
and intersect it with the lists of the other terms. Lists are laid out over the segment so that an
intersection is a look-up. Tasks read the windows from their table, so neither a broadcast nor the
driver holds them; up to ``keep_bytes`` of them stay in a task, more are read again for each segment.

Defined results: null and blank texts have no words and no hits; an item without words or with a
null id is ignored; an item shorter than the window is one window; items that occur twice count
once; repeated rows and null doc ids give a row each; ids may be of any type; columns beyond the named
ones are ignored by the reports and kept by :func:`drop_contaminated`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import any_names, only, raw_texts, shared_path, sliced, written

WINDOW = 10
#: Lower-case A-Z; everything in ASCII that is neither digit nor letter becomes a space.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

POSTINGS = ("doc_words", "terms", "counts", "gaps")
WINDOWS = "width int, terms binary, windows binary, owner_counts binary, owners binary, names array<string>"


def index_words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class _Terms(dict):
    def __missing__(self, term: bytes) -> int:
        self[term] = n = len(self)
        return n


class Segment:
    """An inverted index over a run of documents, with positions counted across them."""

    def __init__(self, doc_words: np.ndarray, terms: list[bytes], counts: np.ndarray, postings: np.ndarray) -> None:
        self.doc_words, self.terms, self.counts, self.postings = doc_words, terms, counts, postings
        self.first = np.cumsum(counts) - counts
        self.number = {t: i for i, t in enumerate(terms)}
        self.term_at = np.empty(len(postings), dtype=np.int32)
        self.term_at[postings] = np.repeat(np.arange(len(terms), dtype=np.int32), counts)
        self.doc_ends = np.cumsum(doc_words)
        self.doc_of = np.repeat(np.arange(len(doc_words), dtype=np.int32), doc_words)

    @classmethod
    def of(cls, texts: list[bytes | None]) -> Segment:
        terms, ids, sizes = _Terms(), [], []
        for text in texts:
            own = index_words(text)
            sizes.append(len(own))
            ids.extend(map(terms.__getitem__, own))
        token = np.array(ids, dtype=np.int32)
        return cls(np.array(sizes, dtype=np.int64), list(terms), np.bincount(token, minlength=len(terms)), np.argsort(token, kind="stable"))

    def row(self) -> tuple[bytes, bytes, bytes, bytes]:
        """Postings are stored as gaps within each list."""
        gaps = np.diff(self.postings, prepend=0)
        gaps[self.first] = self.postings[self.first]
        return self.doc_words.astype("<u4").tobytes(), b" ".join(self.terms), self.counts.astype("<u4").tobytes(), gaps.astype("<u4").tobytes()

    @classmethod
    def read(cls, doc_words: bytes, terms: bytes, counts: bytes, gaps: bytes) -> Segment:
        n = np.frombuffer(counts, "<u4").astype(np.int64)
        total = np.cumsum(np.frombuffer(gaps, "<u4").astype(np.int64))
        before = np.cumsum(n) - n
        base = np.where(before > 0, total[before - 1], 0) if len(n) else n
        return cls(np.frombuffer(doc_words, "<u4").astype(np.int64), terms.split(), n, total - np.repeat(base, n))

    def search(self, windows: np.ndarray, rarest: np.ndarray, vocabulary: list[bytes], slop: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(window number, start) of all occurrences of windows of one length, rarest term first.

        ``rarest`` has the places of each window's terms, from the rarest among the items on. With ``slop``, every term may be up to so many words from its place in the window.
        """
        get = self.number.get
        own = np.array([get(t, -1) for t in vocabulary], dtype=np.int64)
        alive, none = np.arange(len(windows)), np.zeros(0, np.int64)
        for order in rarest.T:  # the rarest first leave few for the others
            alive = alive[own[windows[alive, order[alive]]] >= 0]
        if not len(alive):
            return none, none
        local = own[windows[alive]]
        sizes = self.counts[local]
        rare = np.argmin(sizes, axis=1)
        row = np.arange(len(alive))
        n = sizes[row, rare]
        which = np.repeat(row, n)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        start = self.postings[np.repeat(self.first[local[row, rare]], n) + place] - rare[which]
        if slop:  # the rarest term may be out of its place as well
            moved = np.repeat(start, 2 * slop + 1) + np.tile(np.arange(-slop, slop + 1), len(start))
            both = np.unique(np.stack([np.repeat(which, 2 * slop + 1), moved]), axis=1)
            which, start = both[0], both[1]
        width = windows.shape[1]
        inside = (start >= 0) & (start + width <= len(self.term_at))
        which, start = which[inside], start[inside]
        whole = start + width <= self.doc_ends[self.doc_of[start]]
        which, start = which[whole], start[whole]
        for j in range(width):
            if not len(start):
                break
            want = local[which, j]
            found = self.term_at[start + j] == want
            for d in range(1, slop + 1):
                for at in (start + j - d, start + j + d):
                    there = np.clip(at, 0, len(self.term_at) - 1)
                    found |= (there == at) & (self.term_at[there] == want) & (self.doc_of[there] == self.doc_of[start])
            which, start = which[found], start[found]
        return alive[which], start


def build_index(docs: DataFrame, segment_bytes: int = 4 << 20) -> DataFrame:
    """Write the positional index of ``doc_id`` and ``text`` and return it, a row per segment."""
    slim = only(docs, "doc_id", "text")
    kind = slim.schema["doc_id"].dataType
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", segment_bytes):
            texts = raw_texts(batch.column("text"))
            row = [b"".join(map(text_id, texts)), *Segment.of(texts).row()]
            ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column("doc_id").cast(arrow))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([x], pa.binary()) for x in row]], names=["doc_ids", "text_ids", *POSTINGS])

    schema = T.StructType([T.StructField("doc_ids", T.ArrayType(kind)), *[T.StructField(c, T.BinaryType()) for c in ("text_ids", *POSTINGS)]])
    return written(slim.mapInArrow(run, schema), "positional-index")


def text_id(text: bytes | None) -> bytes:
    """128 bits that name a text."""
    return xxhash.xxh3_128_digest(text or b"")


def write_windows(items: DataFrame, width: int = WINDOW, block_bytes: int = 4 << 20) -> str:
    """Cut items into windows, a row per block of items and window length; returns where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", block_bytes):
            terms, names = _Terms(), {}
            by: dict[int, dict[tuple[int, ...], set[int]]] = {}
            for name, text in zip(batch.column("item_id").to_pylist(), raw_texts(batch.column("text"))):
                own = list(map(terms.__getitem__, index_words(text)))
                if own:
                    item, n = names.setdefault(name, len(names)), min(width, len(own))
                    for i in range(len(own) - n + 1):
                        by.setdefault(n, {}).setdefault(tuple(own[i : i + n]), set()).add(item)
            for n, windows in by.items():
                owners = [sorted(x) for x in windows.values()]
                row = [b" ".join(terms), np.array(list(windows), "<i4").tobytes(), np.array([len(x) for x in owners], "<i4").tobytes(), np.array(sum(owners, []), "<i4").tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.array([x], pa.binary()) for x in row], pa.array([list(names)], pa.list_(pa.string()))], names=[c.split(" ")[0] for c in WINDOWS.split(", ")])

    path = shared_path(items.sparkSession, "test-windows")
    named = only(items, "item_id", "text").where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), "text")
    named.mapInArrow(run, WINDOWS).write.parquet(path)
    return path


class _Block:
    """The windows of one length of a block of items."""

    def __init__(self, row: dict) -> None:
        self.names, self.terms, self.width = row["names"], row["terms"].split(), row["width"]
        self.windows = np.frombuffer(row["windows"], "<i4").reshape(-1, self.width)
        times = np.bincount(self.windows.ravel(), minlength=len(self.terms))
        self.rarest = np.argsort(times[self.windows], axis=1, kind="stable").astype(np.int16)
        n = np.frombuffer(row["owner_counts"], "<i4").astype(np.int64)
        self.first, self.last = np.cumsum(n) - n, np.cumsum(n)
        self.owners = np.frombuffer(row["owners"], "<i4")
        self.bytes = len(row["terms"]) + 3 * len(row["windows"]) + len(row["owners"])


class _Items:
    """Blocks of test windows, read from their table; kept as long as they are few."""

    def __init__(self, path: str, keep_bytes: int = 64 << 20) -> None:
        self.path, self.keep_bytes, self.kept = path, keep_bytes, None

    def _read(self) -> Iterator[_Block]:
        system, path = fs.FileSystem.from_uri(self.path)
        for entry in sorted(x.path for x in system.get_file_info(fs.FileSelector(path)) if x.path.endswith(".parquet")):
            with system.open_input_file(entry) as f:
                for batch in pq.ParquetFile(f).iter_batches(1):
                    yield from map(_Block, batch.to_pylist())

    def __iter__(self) -> Iterator[_Block]:
        if self.kept is not None:
            yield from self.kept
            return
        few, size = [], 0
        for block in self._read():
            yield block
            size += block.bytes
            few = [*few, block] if size <= self.keep_bytes else []
        if size <= self.keep_bytes:
            self.kept = few


def _occurrences(segment: Segment, items: _Items, slop: int = 0):
    """Yields (item name, starts, width) of all items over a segment."""
    for block in items:
        which, start = segment.search(block.windows, block.rarest, block.terms, slop)
        if len(which):
            order = np.argsort(which, kind="stable")
            which, start = which[order], start[order]
            cut = np.flatnonzero(np.diff(which)) + 1
            for w, at in zip(which[np.r_[0, cut]], np.split(start, cut)):
                for item in block.owners[block.first[w] : block.last[w]]:
                    yield block.names[item], at, block.width


def _reported(index: DataFrame, path: str, keep_bytes: int) -> DataFrame:
    """The report of :func:`contamination_report` with the name of each text."""
    kind = index.schema["doc_ids"].dataType.elementType
    names = ["doc_id", "text_id", "n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = _Items(path, keep_bytes)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {c: batch.column(c)[k].as_py() for c in ("text_ids", *POSTINGS)}
                segment = Segment.read(*[row[c] for c in POSTINGS])
                n = len(segment.doc_words)
                edge = np.zeros(len(segment.term_at) + 1, np.int32)
                found: list[set[str]] = [set() for _ in range(n)]
                for name, starts, w in _occurrences(segment, tests):
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + w, -1)
                    for d in np.unique(segment.doc_of[starts]):
                        found[d].add(name)
                hit = np.bincount(segment.doc_of, weights=np.cumsum(edge[:-1]) > 0, minlength=n).astype(np.int64)
                lists = [sorted(s) for s in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[k].values, pa.array([row["text_ids"][16 * i : 16 * i + 16] for i in range(n)], pa.binary()),
                        pa.array(segment.doc_words), pa.array(hit), pa.array([len(x) for x in lists], pa.int64()),
                        pa.array(lists, pa.list_(pa.string())), pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in lists]), pa.array(hit > 0),
                    ],
                    names=names,
                )

    return index.mapInArrow(run, f"doc_id {kind.simpleString()}, text_id binary, n_words bigint, n_hit bigint, n_items bigint, items array<string>, items_sha256 string, contaminated boolean")


def contamination_report(docs: DataFrame, items: DataFrame, width: int = WINDOW, segment_bytes: int = 4 << 20, block_bytes: int = 4 << 20, keep_bytes: int = 64 << 20) -> DataFrame:
    """One row per row of ``docs``: words, words inside occurrences of test windows, items found."""
    path = write_windows(items, width, block_bytes)
    return _reported(build_index(docs, segment_bytes), path, keep_bytes).drop("text_id")


def find_matches(docs: DataFrame, items: DataFrame, width: int = WINDOW, slop: int = 0, segment_bytes: int = 4 << 20, block_bytes: int = 4 << 20, keep_bytes: int = 64 << 20) -> DataFrame:
    """Every exact phrase match, and with ``slop`` every proximity match, of the items' windows.

    Returns doc_id, item_id, first word, width and kind (``phrase`` or ``near``).
    """
    path = write_windows(items, width, block_bytes)
    index = build_index(docs, segment_bytes)
    kind = index.schema["doc_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = _Items(path, keep_bytes)
        for batch in batches:
            for k in range(batch.num_rows):
                segment = Segment.read(*[batch.column(c)[k].as_py() for c in POSTINGS])
                ids = batch.column("doc_ids")[k].values
                exact = {(name, int(s)) for name, starts, _ in _occurrences(segment, tests) for s in starts}
                rows = {(name, int(s), w) for name, starts, w in _occurrences(segment, tests, slop) for s in starts}
                begin = segment.doc_ends - segment.doc_words
                out = [(int(d := segment.doc_of[s]), name, int(s - begin[d]), w, "phrase" if (name, s) in exact else "near") for name, s, w in sorted(rows)]
                for i in range(0, len(out), 10_000):
                    columns = list(zip(*out[i : i + 10_000]))
                    kinds = [pa.string(), pa.int64(), pa.int64(), pa.string()]
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0])), *[pa.array(c, t) for c, t in zip(columns[1:], kinds)]], names=["doc_id", "item_id", "first_word", "width", "kind"])

    return index.mapInArrow(run, f"doc_id {kind.simpleString()}, item_id string, first_word bigint, width bigint, kind string")


@any_names
def drop_contaminated(docs: DataFrame, items: DataFrame, width: int = WINDOW, segment_bytes: int = 4 << 20, block_bytes: int = 4 << 20, keep_bytes: int = 64 << 20) -> DataFrame:
    """The rows of ``docs``, all columns, in which no test window occurs.

    The stored index names the rows to drop, by id and text. Spark broadcasts these while their table
    is under its threshold, else both sides are shuffled.
    """
    path = write_windows(items, width, block_bytes)
    found = _reported(build_index(docs, segment_bytes), path, keep_bytes).where("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_id").alias("__own"))
    found = written(found.distinct(), "contaminated")

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 8 << 20):
            yield batch.append_column("__text", pa.array([text_id(t) for t in raw_texts(batch.column("text"))], pa.binary()))

    named = docs.mapInArrow(identify, T.StructType([*docs.schema, T.StructField("__text", T.BinaryType())]))
    kept = named.join(found, named["doc_id"].eqNullSafe(found["__id"]) & (named["__text"] == found["__own"]), "left_anti")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
