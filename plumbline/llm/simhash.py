"""Near-duplicates by SimHash and bit sampling.

Texts with one set of word 5-shingles are one node. A node's signature has 256 bits, each the sign
of a random projection of its shingles. Several tables sample coordinates; nodes that agree on all
sampled bits of a table share a bucket. Nodes of a bucket within the Hamming distance are candidates,
and the exact Jaccard similarity of their shingle sets decides.

No bucket loses a pair and none is expanded into all its pairs:

* A node is linked to ``links`` near nodes of its bucket, and to more only where these leave it apart
  from a near one; so near nodes of a bucket always hang together through candidates.
* A bucket of more than ``cap`` nodes is ordered by additional sampled bits and cut into parts. Nodes
  are compared within their part first, then with every other part of the bucket, a task holding one.
* Where the exact similarity refuses a candidate, what hung on it is open again: in the zone around
  refused candidates all near pairs between different classes are verified.

Links join nodes to classes by star contraction in written tables.

Limits of the method: a pair at similarity 0.8 meets in one of the tables with a chance of over 0.99,
one at 0.9 with over 0.9998. :meth:`Tables.sized` keeps buckets short and these chances the same as
nodes grow in number. The time of a part is quadratic in ``cap``, that of a bucket in its parts.

Defined results: a null text is empty; texts without words are near only to equal texts; texts of
fewer than five words are one shingle; null ids and repeated rows get a row each, and a class whose
ids are all null has a null class id; extra columns are ignored by :func:`near_duplicates` and kept by
:func:`keep_one_of_each`; ids may be of any type with an order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import any_names, join_spread, mix64, only, raw_texts, sliced, written

WORDS = 5
SALTS = np.array([0x9E6C63D0876A9A62, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], dtype=np.uint64)
SIG = ("s0", "s1", "s2", "s3")
SIGNS = ", ".join(f"{s} bigint" for s in SIG)


@dataclass(frozen=True)
class Tables:
    """80 tables of 14 bits; each has 48 additional bits in store."""

    tables: int = 80
    bits: int = 14
    more: int = 48
    cap: int = 4096
    links: int = 4
    distance: int = 58
    similarity: float = 0.8
    seed: int = 20240229

    @classmethod
    def sized(cls, nodes: int) -> Tables:
        """Bits for buckets of about 128 unrelated nodes, and as many tables as keep the recall.

        A bit agrees with a chance of 0.85 at similarity 0.8, so each further bit asks for 1 / 0.85
        times the tables.
        """
        bits = max(cls.bits, math.ceil(math.log2(max(1, nodes) / 128)))
        return cls(tables=math.ceil(cls.tables * 0.85 ** (cls.bits - bits)), bits=bits)

    def coordinates(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return np.array([rng.permutation(256)[: self.bits + self.more] for _ in range(self.tables)])


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: bytes | None, hashes: dict) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = np.array([*map(hashes.__getitem__, (text or b"").split())], dtype=np.uint64)
    if not len(words):
        return words
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    with np.errstate(over="ignore"):
        total, factor = np.zeros(n, np.uint64), np.uint64(1)
        for k in range(width):
            total += mix64(words[k : k + n]) * factor
            factor *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(mix64(total))


def signature(found: np.ndarray) -> np.ndarray:
    """Four unsigned 64-bit integers; bit 64 k + j is bit j of integer k."""
    counts = np.zeros(256, np.int64)
    for at in range(0, len(found), 4080):
        part = found[at : at + 4080]
        bits = np.unpackbits(mix64(part[:, None] ^ SALTS).view(np.uint8).reshape(len(part), 32), axis=1, bitorder="little")
        for i in range(0, len(part), 255):  # sums of up to 255 bits fit a byte
            counts += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(found), bitorder="little").view(np.uint64)


def _as_long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def text_id(text: bytes | None) -> bytes:
    """128 bits that name a text."""
    return xxhash.xxh3_128_digest(text or b"")


def sign_documents(docs: DataFrame, most_words: int = 500_000) -> DataFrame:
    """doc_id, names of the text and of its shingle set, number of shingles and signature, written once."""
    kind = only(docs, "doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in sliced(batches, "text", 4 << 20):
            if len(hashes) > most_words:
                hashes = _Hashes()
            texts, sets, sizes, signs = [], [], [], []
            for text in raw_texts(batch.column("text")):
                found = shingles(text, hashes)
                texts.append(text_id(text))
                sets.append(xxhash.xxh3_128_digest(found.tobytes(), seed=1) if len(found) else texts[-1])
                sizes.append(len(found))
                signs.append(signature(found))
            sign = _as_long(np.array(signs, dtype=np.uint64)).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(texts, pa.binary()), pa.array(sets, pa.binary()), pa.array(sizes, pa.int32()), *[pa.array(sign[:, k]) for k in range(4)]],
                names=["doc_id", "text_id", "set_id", "n", *SIG],
            )

    return written(only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {kind}, text_id binary, set_id binary, n int, {SIGNS}"), "signatures")


def make_nodes(signed: DataFrame) -> DataFrame:
    """A numbered node per shingle set: its rows, least id, and the row whose text stands for it."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")
    nodes = signed.groupBy("set_id").agg(F.min(row).alias("row"), F.count("*").alias("rows"), F.first("n").alias("n"), *[F.first(s).alias(s) for s in SIG])
    return written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")


def _sampled(sign: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The named bits of each signature as one integer, first named highest."""
    out = np.zeros(len(sign), np.uint64)
    for c in places:
        out = (out << np.uint64(1)) | ((sign[:, c >> 6] >> np.uint64(c & 63)) & np.uint64(1))
    return out


def _entries(tables: Tables, columns: tuple[str, ...]):
    """A row per node and table: bucket, additional bits, and ``columns``, of which the last four are the signature."""
    coordinates = tables.coordinates()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                own = [part.column(c) for c in columns]
                sign = np.stack([np.asarray(x).view(np.uint64) for x in own[-4:]], axis=1)
                for t, places in enumerate(coordinates):
                    key = (np.uint64(t) << np.uint64(tables.bits)) | _sampled(sign, places[: tables.bits])
                    more = _sampled(sign, places[tables.bits :])
                    yield pa.RecordBatch.from_arrays([pa.array(_as_long(key)), pa.array(_as_long(more)), *own], names=["key", "more", *columns])

    return run


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least index that each index hangs together with through pairs (i, j)."""
    label = np.arange(n)
    while True:
        before, low = label.copy(), np.minimum(label[i], label[j])
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        np.minimum.at(label, before[i], low)
        np.minimum.at(label, before[j], low)
        label = label[label]
        if (label == before).all():
            return label


def _bridges(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs, in order, that join different labels; ``label`` follows."""
    found = []
    for a, b in zip(i[label[i] != label[j]].tolist(), j[label[i] != label[j]].tolist()):
        if label[a] != label[b]:
            label[label == label[b]] = label[a]
            found.append((a, b))
    return found


def near_pairs(sign: np.ndarray, group: np.ndarray, cls: np.ndarray | None, distance: int, links: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of near rows of different ``cls`` in one run of equal ``group``.

    With ``links``, so many for a row with rows before it, and one for any two rows that would be apart.
    """
    n = len(group)
    first, count, done = np.searchsorted(group, group), np.zeros(n, np.int64), np.zeros(n, np.int64)
    left, right, live, d = [], [], np.arange(n), 0

    def near(rows: np.ndarray) -> np.ndarray:
        far = np.bitwise_count(sign[rows] ^ sign[rows - d]).sum(axis=1, dtype=np.int32)
        return rows[(far <= distance) if cls is None else (far <= distance) & (cls[rows] != cls[rows - d])]

    while True:
        d += 1
        live = live[live - d >= first[live]]
        if not len(live):
            break
        found = near(live)
        if len(found):
            left.append(found - d)
            right.append(found)
            if links:
                count[found] += 1
                done[found[count[found] >= links]] = d
                live = live[count[live] < links]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, j = np.concatenate(left), np.concatenate(right)
    live = np.flatnonzero((done > 0) & (np.arange(n) - done > first))
    if len(live):
        label, bridges, d = _labels(n, i, j), [], int(done[live].min())
        while len(live):
            d += 1
            live = live[live - d >= first[live]]
            found = near(live[done[live] < d])
            bridges += _bridges(label, found - d, found)
        both = np.array(bridges, np.int64).reshape(-1, 2)
        i, j = np.concatenate([i, both[:, 0]]), np.concatenate([j, both[:, 1]])
    return i, j


BUCKETS = f"a bigint, b bigint, key bigint, part int, cls bigint, {SIGNS}"
ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("part", pa.int32()), ("cls", pa.int64()), *[(s, pa.int64()) for s in SIG]])


def _pair_rows(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))]
    return pa.RecordBatch.from_arrays([*columns, *[pa.nulls(len(a), f.type) for f in list(ARROW)[2:]]], schema=ARROW)


def _compare(tables: Tables, links: int | None):
    """Streams entries in the order of bucket and additional bits and holds about ``cap`` rows of a bucket.

    Yields candidate pairs (a, b), and each member of a bucket over the cap as (a, key, part, ...).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        big, parts = None, 0  # the bucket over the cap that is being read, and its parts so far
        for batch in _with_end(batches):
            if batch is not None:
                classed = "cls" in batch.schema.names
                names = ("key", "node", "cls" if classed else "node", *SIG)
                own = [np.asarray(batch.column(c)) for c in names]
                new = [*own[:3], np.stack([x.view(np.uint64) for x in own[3:]], axis=1)]
                rest = new if rest is None else [np.concatenate(p) for p in zip(rest, new)]
                if len(rest[0]) < 4 * tables.cap:
                    continue
            if rest is None or not len(rest[0]):
                return
            key = rest[0]
            run_of = _runs(key)
            start, size = np.flatnonzero(np.diff(run_of, prepend=-1)), np.bincount(run_of)
            place = np.arange(len(key)) - start[run_of]
            over = (size > tables.cap)[run_of] | (key == big if big is not None else False)
            part = np.where(over, place // tables.cap, 0)
            part[key == big] += parts
            end = len(key)
            if batch is not None:  # the last bucket may go on, but whole parts of one over the cap are complete
                end = int(start[-1]) + (int(size[-1]) // tables.cap * tables.cap if over[-1] else 0)
            node, cls, sign = (p[:end] for p in rest[1:])
            i, j = near_pairs(sign, _runs(run_of[:end], part[:end]), cls if classed else None, tables.distance, links)
            yield _pair_rows(node[i], node[j])
            at = np.flatnonzero(over[:end])
            if len(at):
                columns = [pa.array(node[at]), pa.nulls(len(at), pa.int64()), pa.array(key[at]), pa.array(part[at].astype(np.int32)), pa.array(cls[at]), *[pa.array(_as_long(sign[at, k])) for k in range(4)]]
                yield pa.RecordBatch.from_arrays(columns, schema=ARROW)
                big, parts = int(key[at[-1]]), int(part[at[-1]]) + 1
            rest = [p[end:] for p in rest]

    return run


def _cross(tables: Tables, links: int | None):
    """Streams parts of buckets, each followed by the nodes of later parts, and compares these with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, node, cls, sign = None, *([np.zeros(0, np.int64)] * 2), np.zeros((0, 4), np.uint64)
        for batch in batches:
            whole = [np.asarray(batch.column(c)) for c in ("key", "part", "probe", "a", "cls", *SIG)]
            cuts = np.flatnonzero(np.diff(_runs(whole[0], whole[1], whole[2]))) + 1
            for rows in np.split(np.arange(batch.num_rows), cuts):
                for k in range(0, len(rows), 512):
                    own = [c[rows[k : k + 512]] for c in whole]
                    new = (own[3], own[4], np.stack([x.view(np.uint64) for x in own[5:]], axis=1))
                    if (own[0][0], own[1][0]) != at:
                        at, (node, cls, sign) = (own[0][0], own[1][0]), (x[:0] for x in new)
                    if not own[2][0]:
                        node, cls, sign = (np.concatenate(x) for x in zip((node, cls, sign), new))
                        continue
                    far = np.zeros((len(new[0]), len(node)), np.int16)
                    for c in range(4):
                        far += np.bitwise_count(new[2][:, c, None] ^ sign[None, :, c])
                    near = (far <= tables.distance) & (new[1][:, None] != cls[None, :])
                    taken = near & (np.cumsum(near, axis=1) <= links) if links else near
                    p, m = np.nonzero(taken)
                    q, o = np.nonzero(near & ~taken)
                    if len(q):
                        label = _labels(len(node) + len(new[0]), m, p + len(node))
                        both = np.array(_bridges(label, o, q + len(node)), np.int64).reshape(-1, 2)
                        m, p = np.concatenate([m, both[:, 0]]), np.concatenate([p, both[:, 1] - len(node)])
                    yield _pair_rows(node[m], new[0][p])

    return run


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Numbers runs of equal values in sorted columns from 0."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def _with_end(batches):
    yield from batches
    yield None


def candidate_pairs(entries: DataFrame, tables: Tables, links: int | None) -> DataFrame:
    """Distinct pairs of nodes (a < b) that share a bucket and lie within the distance."""
    ordered = entries.repartition("key").sortWithinPartitions("key", "more")
    found = written(ordered.mapInArrow(_compare(tables, links), BUCKETS), "buckets")
    pairs, members = found.where("b IS NOT NULL").select("a", "b"), found.where("part IS NOT NULL").drop("b")
    if not members.isEmpty():
        earlier = members.where("part > 0").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("part") - 1)))
        rows = members.withColumn("probe", F.lit(False)).unionByName(earlier.withColumn("probe", F.lit(True)))
        rows = rows.repartition("key", "part").sortWithinPartitions("key", "part", "probe")
        pairs = pairs.union(rows.mapInArrow(_cross(tables, links), BUCKETS).select("a", "b"))
    return pairs.distinct()


def _chosen_rows(docs: DataFrame, chosen: DataFrame, how: str) -> DataFrame:
    """Rows of ``docs`` that are a chosen row, its equals among them.

    Copies of a text differ in their id, so the join spreads them over all tasks.
    """
    docs = _with_text_id(docs)
    right = chosen.select(F.col("row.doc_id").alias("__id"), F.col("row.text_id").alias("__own"), *[c for c in chosen.columns if c == "node"]).hint("shuffle_hash")
    return docs.join(right, docs["doc_id"].eqNullSafe(right["__id"]) & (docs["__text"] == right["__own"]), how)


def _with_text_id(docs: DataFrame) -> DataFrame:
    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 8 << 20):
            yield batch.append_column("__text", pa.array([text_id(t) for t in raw_texts(batch.column("text"))], pa.binary()))

    return docs.mapInArrow(identify, T.StructType([*docs.schema, T.StructField("__text", T.BinaryType())]))


def shingle_sets(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """node and shingle set of the nodes in ``pairs``, from one text of each, written once."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in sliced(batches, "text", 2 << 20):
            if len(hashes) > 500_000:
                hashes = _Hashes()
            sets = [shingles(t, hashes).tobytes() for t in raw_texts(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    involved = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    chosen = nodes.select("node", "row").join(involved, "node", "left_semi")
    texts = _chosen_rows(only(docs, "doc_id", "text"), chosen, "inner").select("node", "text")
    return written(texts.mapInArrow(collect, "node bigint, shingles binary").dropDuplicates(["node"]), "shingles")


def verify_pairs(pairs: DataFrame, sets: DataFrame, tables: Tables) -> DataFrame:
    """``pairs`` and whether their shingle sets reach the similarity, written once."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                p, q = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                both = len(np.intersect1d(p, q, assume_unique=True))
                near.append(both >= tables.similarity * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near, pa.bool_())], names=["a", "b", "near"])

    joined = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return written(joined.select("a", "b", "x", "y").mapInArrow(judge, "a bigint, b bigint, near boolean"), "verified")


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """node and class (its least node) of every linked node, by alternating star contraction."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """Join each node's neighbours, all greater ones or all lesser ones, to its least neighbour.

        Both sides of the join are read from tables, so that the rows of a hub can be split at run time.
        """
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        joined = both.join(least, "a")
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return written(out.where("a <> b").distinct(), "stars")

    edges, before = links.select("a", "b"), None
    if edges.isEmpty():
        return edges.selectExpr("a AS node", "a AS class")
    for _ in range(most):
        edges = star(star(edges, True), False)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"classes still change after {most} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("class")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("class")).distinct())


def _of_classes(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of different classes that ``pairs`` of nodes join."""
    for c in ("a", "b"):
        own = found.select(F.col("node").alias(c), F.col("class").alias("__c"))
        pairs = pairs.join(own, c, "left").withColumn(c, F.coalesce("__c", c)).drop("__c")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def _zones(refused: DataFrame, found: DataFrame) -> DataFrame:
    """node, cls and zone of nodes around refused candidates, where more than one pair is open."""
    near = written(_of_classes(refused, found), "refused")
    zones = components(near).select(F.col("node").alias("class"), F.col("class").alias("zone"))
    linked = found.join(zones, "class").select("node", F.col("class").alias("cls"), "zone")
    alone = zones.join(found, "class", "left_anti").select(F.col("class").alias("node"), F.col("class").alias("cls"), "zone")
    all_of = written(linked.union(alone), "zones")
    return all_of.join(all_of.groupBy("zone").count().where("count > 2").select("zone"), "zone", "left_semi").select("node", "cls", "zone")


def find_classes(docs: DataFrame, nodes: DataFrame, tables: Tables) -> DataFrame:
    """node and class of every node that is linked to another."""
    columns = ("node", *SIG)
    entries = nodes.where("n > 0").select(*columns).mapInArrow(_entries(tables, columns), f"key bigint, more bigint, node bigint, {SIGNS}")
    pairs = written(candidate_pairs(entries, tables, tables.links), "candidates")
    sets = shingle_sets(docs, nodes, pairs)
    tested = verify_pairs(pairs, sets, tables)
    found = written(components(tested.where("near")), "classes")
    open_ = _zones(tested.where("NOT near"), found)
    if open_.isEmpty():
        return found
    columns = ("node", "cls", "zone", *SIG)
    entries = open_.join(nodes.select("node", *SIG), "node").select(*columns).mapInArrow(_entries(tables, columns), f"key bigint, more bigint, node bigint, cls bigint, zone bigint, {SIGNS}")
    rest = candidate_pairs(entries.withColumn("key", F.xxhash64("key", "zone")).drop("zone"), tables, None)
    rest = written(rest.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "open-candidates")
    joined = _of_classes(verify_pairs(rest, sets, tables).where("near").select("a", "b"), found)
    wider = components(written(joined, "wider"))
    return found.select("node", "class").union(wider.join(found, "node", "left_anti").select("node", F.col("node").alias("class"))).join(
        wider.select(F.col("node").alias("class"), F.col("class").alias("__wide")), "class", "left"
    ).select("node", F.coalesce("__wide", "class").alias("class"))


def _classes(docs: DataFrame, signed: DataFrame, tables: Tables | None) -> DataFrame:
    """Set, class, row and number of rows of every node."""
    nodes = make_nodes(signed)
    tables = tables or Tables.sized(nodes.count())
    found = find_classes(docs, nodes, tables)
    return nodes.select("node", "set_id", "row", "rows").join(found, "node", "left").select("set_id", F.coalesce("class", "node").alias("class"), "row", F.col("rows").alias("n"))


def near_duplicates(docs: DataFrame, tables: Tables | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id and class_id, the least id of its class."""
    signed = sign_documents(docs)
    classes = written(_classes(docs, signed, tables), "node-classes")
    names = classes.groupBy("class").agg(F.min("row.doc_id").alias("class_id"), F.count("*").alias("n"))
    of_node = join_spread(classes.select("set_id", "class", F.col("n").alias("rows")), names, "class", classes.count())
    of_node = written(of_node.select("set_id", "class_id", F.col("rows").alias("n")), "node-names")
    return join_spread(signed.select("doc_id", "set_id"), of_node, "set_id", signed.count()).select("doc_id", "class_id")


@any_names
def keep_one_of_each(docs: DataFrame, tables: Tables | None = None) -> DataFrame:
    """The rows of ``docs``, all columns: of each class the row with the least id, null ids last."""
    signed = sign_documents(docs)
    chosen = written(_classes(docs, signed, tables).groupBy("class").agg(F.min("row").alias("row")), "chosen")
    kept = _chosen_rows(docs, chosen, "left_semi")
    repeated = signed.groupBy("doc_id", "text_id").count().where("count > 1")
    if not repeated.isEmpty():
        first = Window.partitionBy("doc_id", "__text").orderBy(*[F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")])
        kept = kept.withColumn("__nth", F.row_number().over(first)).where("__nth = 1")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])
