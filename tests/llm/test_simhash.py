import datetime
import random

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import simhash as S

SCHEMA = "doc_id bigint, text string, Node string"


def jaccard(a, b):
    def sets(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y) if x | y else 0


def brute_force(rows):
    texts = sorted({t or "" for _, t in rows})
    parent = {t: t for t in texts}

    def root(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            if jaccard(a, b) >= 0.8:
                parent[root(a)] = root(b)
    groups = {}
    for d, t in rows:
        groups.setdefault(root(t or ""), []).append(d)
    least = {r: min((d for d in g if d is not None), default=None) for r, g in groups.items()}
    return sorted(((d, least[root(t or "")]) for d, t in rows), key=repr)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows = [(1, None), (2, ""), (3, " "), (4, "one two"), (5, "one two"), (6, "one two three"), (None, "lonely text without id")]
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.choice([8, 60, 300]))
        rows.append((100 * i + 10, " ".join(words)))
        for c in range(rng.randrange(4)):
            near = list(words)
            for _ in range(rng.choice([0, 1, 2, len(words) // 20])):
                near[rng.randrange(len(near))] = rng.choice(vocabulary)
            rows.append((100 * i + 11 + c, " ".join(near)))
    rows += [(90_000, "long " + " ".join(rng.choices(vocabulary, k=40_000))), rows[-1], rows[-1]]
    return rows


def test_classes(spark):
    rows = corpus()
    got = S.near_duplicates(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == brute_force(rows)


def test_one_of_each_stays(spark):
    rows = corpus(2)
    kept = S.keep_one_of_each(spark.createDataFrame([(d, t, str(i)) for i, (d, t) in enumerate(rows)], SCHEMA))
    assert kept.columns == ["doc_id", "text", "Node"]
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted({c for _, c in brute_force(rows)} | {None}, key=repr)


def test_nothing(spark):
    assert S.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    assert S.keep_one_of_each(spark.createDataFrame([], SCHEMA)).collect() == []


def pairs_of(sign, node, tables, chunk, links, cls=None):
    """Candidates of the streamed comparison, and of the parts of buckets over the cap."""
    columns = ("node", *(() if cls is None else ("cls",)), *S.SIG)
    arrays = [pa.array(node), *([] if cls is None else [pa.array(cls)]), *[pa.array(S._as_long(sign[:, k])) for k in range(4)]]
    entries = pa.Table.from_batches(list(S._entries(tables, columns)([pa.RecordBatch.from_arrays(arrays, names=list(columns))])))
    table = entries.sort_by([("key", "ascending"), ("more", "ascending")])
    rows = pa.Table.from_batches(list(S._compare(tables, links)(iter(table.to_batches(max_chunksize=chunk)))))
    found = {(r["a"], r["b"]) for r in rows.to_pylist() if r["b"] is not None}
    members = [r for r in rows.to_pylist() if r["part"] is not None]
    probes = [r | {"part": p, "probe": True} for r in members for p in range(r["part"])]
    if members:
        order = sorted([r | {"probe": False} for r in members] + probes, key=lambda r: (r["key"], r["part"], r["probe"]))
        crossed = S._cross(tables, links)(iter(pa.Table.from_pylist(order, schema=S.ARROW.append(pa.field("probe", pa.bool_()))).to_batches(max_chunksize=chunk)))
        found |= {(a, b) for x in crossed for a, b in zip(x.column("a").to_pylist(), x.column("b").to_pylist())}
    return found, {(r["key"], r["part"]) for r in members}


def family(n=400, seed=0):
    """Random signatures, and among them 200 that differ in a few bits."""
    rng = np.random.default_rng(seed)
    sign = rng.integers(0, 1 << 63, (n, 4), dtype=np.uint64)
    sign[100:300] = sign[100]
    for i in range(150, 300):
        for b in rng.integers(0, 252, rng.integers(1, 45)):
            sign[i, b // 63] ^= np.uint64(1) << np.uint64(b % 63)
    return sign


def true_pairs(sign, tables, cls=None):
    """Near pairs that share a bucket, by brute force."""
    found = set()
    for places in tables.coordinates():
        key = S._sampled(sign, places[: tables.bits])
        for k in np.unique(key):
            at = np.flatnonzero(key == k)
            far = np.bitwise_count(sign[at][:, None] ^ sign[at][None]).sum(axis=2, dtype=int)
            found |= {(int(a), int(b)) for i, a in enumerate(at) for j, b in enumerate(at) if a < b and far[i, j] <= tables.distance and (cls is None or cls[a] != cls[b])}
    return found


def hang(pairs, n):
    label = np.arange(n)
    for a, b in sorted(pairs):
        label[label == label[b]] = label[a]
    return label


@pytest.mark.parametrize("cap", [4096, 37, 8])
@pytest.mark.parametrize("chunk", [7, 10_000])
def test_every_pair_of_a_bucket_is_found(cap, chunk):
    sign, tables = family(), S.Tables(tables=4, bits=4, cap=cap)
    want = true_pairs(sign, tables)
    found, parts = pairs_of(sign, np.arange(400), tables, chunk, None)
    assert found == want
    assert (len(parts) > 4) == (cap < 100)
    cls = np.where(np.arange(400) % 3 == 0, 1000, np.arange(400))
    assert pairs_of(sign, np.arange(400), tables, chunk, None, cls)[0] == true_pairs(sign, tables, cls)


@pytest.mark.parametrize("cap", [4096, 37, 8])
@pytest.mark.parametrize("links", [1, 4])
def test_few_links_keep_near_nodes_together(cap, links):
    for seed in range(3):
        sign, tables = family(seed=seed), S.Tables(tables=2, bits=4, cap=cap)
        want = true_pairs(sign, tables)
        found, _ = pairs_of(sign, np.arange(400), tables, 90, links)
        assert found <= want
        assert len(found) < 0.75 * len(want)
        label = hang(found, 400)
        assert all(label[a] == label[b] for a, b in want)


def test_tables_grow_with_the_nodes():
    assert S.Tables.sized(0) == S.Tables.sized(1_000_000) == S.Tables()
    more = S.Tables.sized(1 << 30)
    assert (more.bits, more.tables) == (23, 346)
    assert more.tables * 0.85**more.bits >= 80 * 0.85**14
    assert more.coordinates().shape == (346, 71)


def dense(seed, size=150, words=200):
    """A family of texts around one, each with its own edits, and texts that only just reach some of them."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = rng.choices(vocabulary, k=words)

    def edited(source, k):
        out = list(source)
        for _ in range(k):
            out[rng.randrange(len(out))] = rng.choice(vocabulary)
        return out

    texts = [edited(base, rng.choice([1, 1, 2])) for _ in range(size)]
    texts += [edited(base, k) for k in (3, 4, 5, 6, 7, 8) for _ in range(8)]
    texts += [edited(rng.choice(texts), k) for k in (3, 4, 5) for _ in range(8)]
    return [(i, (" " if i % 2 else "\n").join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize("cap", [4096, 16])
def test_a_dense_family_loses_no_link(spark, cap):
    """Without sampled bits every pair meets; then classes are those of brute force at any cap."""
    rows = dense(3)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = S.near_duplicates(docs, S.Tables(tables=1, bits=0, cap=cap, distance=256)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in got), key=repr) == brute_force(rows)
    again = S.near_duplicates(docs, S.Tables(cap=cap)).collect()
    assert sorted(((r.doc_id, r.class_id) for r in again), key=repr) == brute_force(rows)


def test_texts_of_one_shingle_set_are_one_node(spark):
    rows = [(i, " " * (i % 5 + 1) + "one two three four five six" + "\n" * i) for i in range(40)] + [(50, ""), (51, " "), (52, None), (53, "one two three four five seven eight")]
    got = {r.doc_id: r.class_id for r in S.near_duplicates(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)).collect()}
    assert got == {i: 0 for i in range(40)} | {50: 50, 51: 51, 52: 50, 53: 53}


@pytest.mark.parametrize("kind", ["string", "smallint", "date"])
def test_ids_of_other_types(spark, kind):
    make = {"string": lambda i: f"d{i}", "date": lambda i: datetime.date(2020, 1, 1 + i)}.get(kind, int)
    rows = [(make(i), t) for i, t in enumerate(["a b c d e f", "a b c d e  f", "x y z"])] + [(None, "x y z"), (None, "q")]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    got = sorted(map(tuple, S.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(make(0), make(0)), (make(1), make(0)), (make(2), make(2)), (None, make(2)), (None, None)], key=repr)
    assert sorted((r.doc_id for r in S.keep_one_of_each(docs).collect()), key=repr) == sorted([make(0), make(2), None], key=repr)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 160)] + [(200, 201)]
    got = dict(map(tuple, S.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
