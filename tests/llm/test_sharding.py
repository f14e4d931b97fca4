import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from plumbline.llm import sharding as H

SCHEMA = "doc_id bigint, text string, Extra string"


def corpus(seed, n=3000):
    rng = random.Random(seed)
    rows = [(None, None), (None, None), (1, ""), (2, None), (3, "é" * 1000)]
    rows += [(i, "x" * rng.randrange(10, 600)) for i in range(n)]
    rows += [(10_000 + i, "the same text " * 10) for i in range(n // 2)]  # a third: one text
    rows += [(77, "one row again and again " * 4) for i in range(n // 2)]  # and one row
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_are_near_equal(spark, seed):
    rows = corpus(seed)
    got = H.assign_shards(spark.createDataFrame([(d, t, "") for d, t in rows], SCHEMA).repartition(6), 40, rows_per_group=20).collect()
    size = lambda t: len((t or "").encode()) + 16
    want = Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r)
    assert sorted(by) == list(range(40))
    share = sum(r.size for r in got) / 40
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - share) <= 0.005 * share + 2 * 620 + 2016


def test_equal_texts_stay_together_where_they_can(spark):
    rows = [(i, f"text {i % 700} " * 5) for i in range(7000)]
    got = H.assign_shards(spark.createDataFrame([(d, t, "") for d, t in rows], SCHEMA), 8, tolerance=0.02).collect()
    places = defaultdict(set)
    for r in got:
        places[r.text_crc32].add(r.shard)
    assert sum(len(p) > 1 for p in places.values()) <= 7


def test_few_rows(spark):
    assert H.assign_shards(spark.createDataFrame([], SCHEMA), 40).collect() == []
    one = H.assign_shards(spark.createDataFrame([(1, "a", "")], SCHEMA), 40).collect()
    assert len(one) == 1 and one[0].slot == 0 and 0 <= one[0].shard < 40


def test_documents_move_whole(spark):
    rows = [(d, t, str(i)) for i, (d, t) in enumerate(corpus(3, 300))]
    out = H.shard_documents(spark.createDataFrame(rows, SCHEMA).repartition(4), 8)
    assert out.columns == ["doc_id", "text", "Extra", "shard"]
    assert Counter((r.doc_id, r.text, r.Extra) for r in out.collect()) == Counter(rows)
    own = out.withColumn("p", F.spark_partition_id()).select("p", "shard").distinct().collect()
    assert sorted((r.p, r.shard) for r in own) == [(i, i) for i in range(8)]
    clash = H.shard_documents(spark.createDataFrame([(1, "a", 2, 3)], "doc_id bigint, text string, Size int, k0 int"), 8)
    assert clash.columns == ["doc_id", "text", "Size", "k0", "shard"] and clash.first()[:4] == (1, "a", 2, 3)


def cuts_by_hand(keys, sizes, shards):
    """Bytes below the best limit of each shard, where limits may lie at any key."""
    order, at, below = sorted(zip(keys, sizes)), [0], 0
    for i, (k, n) in enumerate(order):
        below += n
        if i + 1 == len(order) or order[i + 1][0] != k:
            at.append(below)
    return [min(at, key=lambda b: (abs(b - round(below * s / shards)), b)) for s in range(1, shards)]


@pytest.mark.parametrize(("shards", "bits"), [(7, 10), (40, 3), (300, 6)])
def test_limits_are_the_nearest_there_are(spark, shards, bits):
    """With no tolerance each limit has the bytes below it that brute force over all keys finds."""
    rng = random.Random(shards)
    rows = [(rng.choice([5, -7, H.LOW, H.HIGH, rng.getrandbits(63)]), rng.choice([0, H.HIGH, rng.getrandbits(62)]), i - 700, rng.randrange(16, 900)) for i in range(1500)]
    slim = spark.createDataFrame(rows, "k0 bigint, k1 bigint, k2 bigint, size bigint")
    limits = H.find_limits(slim, sum(r[3] for r in rows), shards, 0.0, bits)
    found = [sum(n for *k, n in rows if tuple(k) < limit.key) for limit in limits]
    assert found == cuts_by_hand([r[:3] for r in rows], [r[3] for r in rows], shards)
    placed = slim.withColumn("shard", H._shard(limits, 0, len(limits))).collect()
    assert all(r.shard == sum(limit.key <= (r.k0, r.k1, r.k2) for limit in limits) for r in placed)


@pytest.mark.parametrize("kind", ["string", "smallint", "int"])
def test_ids_of_other_types(spark, kind):
    ids = ["7", "8", None] if kind == "string" else [7, 8, None]
    got = H.assign_shards(spark.createDataFrame([(i, "x") for i in ids], f"doc_id {kind}, text string"), 3).collect()
    assert sorted((r.doc_id for r in got), key=repr) == sorted(ids, key=repr)
