"""Cases of the second round's findings: each fails on the code before it."""

import hashlib
import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline.catalog import ORACLES, QUERIES
from plumbline.functions.md5 import Messages
from plumbline.functions.text import upper
from plumbline.operators import contamination as N
from plumbline.operators import curves as C
from plumbline.operators import retrieval as Q
from plumbline.operators import statistics as S
from plumbline.sources.tables import saved_path


def test_capitals_are_those_of_sql(spark, tmp_path):
    texts = ["Erßi", "ᾀst", "ŉx", "ﬁn", "ñez", "a\nb", "😀ß", "", "ẞ"]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.id: r.gold for r in QUERIES["tasks_round_trip"](spark, str(tmp_path)).collect()}
    duckdb_rows = duckdb.sql(f"SELECT item_id::VARCHAR, upper(text[1:3]) FROM '{tmp_path}/benchmark.parquet/*.parquet'").fetchall()
    assert got == dict(duckdb_rows) and got["0"] == "ERẞ" and "tasks_round_trip" in ORACLES
    assert spark.range(1).select(upper(F.lit(None).cast("string")).alias("u")).first().u is None


def _plain_matches(own, ref, n):
    runs = {tuple(r[i : i + k]) for r in ref for k in range(1, 13) for i in range(len(r) - k + 1)}
    longest = max((k for k in range(1, 13) for i in range(len(own) - k + 1) if tuple(own[i : i + k]) in runs), default=0)
    grams = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)}
    return longest, len([g for g in grams if g in runs]) / len(grams) if grams else None


def test_matches_of_a_small_side_are_found_in_one_pass(spark, monkeypatch):
    """Either side small, and neither: words and texts against brute force, without a round of its own per length."""
    rng = random.Random(5)
    many = [[rng.choice("abcdefg") for _ in range(rng.choice([0, 1, 3, 30, 60]))] for _ in range(60)]
    few = [[rng.choice("abcxyz") for _ in range(rng.choice([2, 20, 40]))] for _ in range(4)] + [many[7][2:40] + ["q"]]
    written = []
    monkeypatch.setattr(N, "saved_path", lambda df, name: written.append(name) or saved_path(df, name))
    for bound in (N.RUNS, 0):
        monkeypatch.setattr(N, "RUNS", bound)
        for own, ref in ((many, few), (few, many)):
            for text in (True, False):
                kind = "string" if text else "array<string>"
                frame = lambda rows: spark.createDataFrame([(i, "".join(r) if text else r) for i, r in enumerate(rows)] + [(99, None)], f"name int, seq {kind}").repartition(3)  # noqa: E731, B023
                del written[:]
                got = {r.name: r for r in N.contamination_report(frame(own).withColumn("name", F.col("name").cast("string")), frame(ref), None, (3, 14), 12, text=text).collect()}
                assert not bound or len(written) <= 2
                for i, r in enumerate(own):
                    longest, share = _plain_matches(r, ref, 3)
                    assert (got[str(i)].longest_match, got[str(i)].capped, got[str(i)].overlap_3) == (longest, longest >= 12, share)
                    assert (got[str(i)].overlap_14 is None) == (len(r) < 14)
                assert got["99"].longest_match == 0 and got["99"].overlap_3 is None
                alone = {r.name: r.overlap for r in N.ngram_overlap(frame(own), frame(ref), 3, text=text).collect()}
                assert all(alone[i] == _plain_matches(r, ref, 3)[1] for i, r in enumerate(own))


def test_first_bits_of_md5():
    keys = [b"", "ä".encode(), *(str(i).encode() for i in range(3000))]
    for prefix in (b"", b"5|", b"5|12|", b"p" * 53):
        want = [int(hashlib.md5(prefix + k + b"|0").hexdigest()[:8], 16) for k in keys]
        assert Messages(keys).heads(prefix, b"|0").tolist() == want


def _vectors(spark, n):
    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(n, 8)), 1)
    x[n // 2 :] = x[: n - n // 2]  # ties
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id bigint, vector array<float>").repartition(3)


def test_sampled_search_draws_what_all_pairs_draw(spark):
    docs = _vectors(spark, 900)
    queries = docs.where("doc_id % 60 = 0").select(F.col("doc_id").alias("query"), "vector")
    scores = Q.dense_scores(docs, queries).withColumn("score", F.round("score", 9))
    for beta in (4.0, -2.0, 0.0):
        key = lambda df: sorted((r.query, r.pos, r.doc_id, round(r.score, 6)) for r in df.collect())
        want = key(Q.sampled_ranking(scores, 7, beta, 3))
        assert len(want) == 15 * 7 and key(Q.sampled_search(docs, queries, 7, beta, 3, block=4, rows=100)) == want


def test_searches_make_no_pairs_in_rows(spark):
    """Blocks of documents meet blocks of queries in tasks: neither plan joins documents with queries."""
    docs = _vectors(spark, 400)
    queries = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "vector")
    c = Q.ivf_fit(docs, 5)
    found = Q.ivf_search(Q.ivf_index(docs, c), c, queries, 6, 5, block=7, rows=50)
    exact = Q.dense_search(docs, queries, 6, block=7, rows=50)
    for df in (found, exact, Q.sampled_search(docs, queries, 6, 4.0)):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    key = lambda df: sorted((r.query, r.pos, r.doc_id, round(r.score, 6)) for r in df.collect())
    best = Q.top(Q.dense_scores(docs, queries).withColumn("score", F.round("score", 9)), 6)
    assert key(found) == key(exact) == key(best)  # all lists are probed


def test_sharpness_draws_the_same_clusters_in_pieces(spark):
    """The clusters of one generator over (draws, clusters), where no task sees a group."""
    rng = np.random.default_rng(4)
    rows = [(g, x, f"i{i}", f"c{i % (37 + g)}", rng.integers(0, 2, rng.integers(1, 4)).tolist()) for g in (0, 1) for x in (1, 2, 4) for i in range(150)]
    df = spark.createDataFrame(rows, "g int, x int, item_id string, cluster string, ok array<int>").repartition(5)
    got = {(r.g, r.m): r for r in C.subsampled_sharpness(df, "x", "ok", [3, 37], 25, by=["g"], piece=10).collect()}
    for g in (0, 1):
        items = sorted({r[2] for r in rows})
        label = {r[2]: r[3] for r in rows if r[0] == g}
        codes = C._codes(pd.Series([label[i] for i in items]))
        right = {x: np.array([min(next(r[4] for r in rows if r[:3] == (g, x, i))) for i in items], float) for x in (1, 2, 4)}
        for m in (3, 37):
            w = C.draw_weights(np.random.default_rng(1), 37 + g, 25, m)[:, codes]
            s = C.gradient(np.array([1.0, 2.0, 4.0]), np.stack([(w @ right[x]) / w.sum(axis=1) for x in (1, 2, 4)], axis=1), True).max(axis=1)
            assert (got[g, m].s_mean, got[g, m].s_sd, got[g, m].n_draw) == (s.mean(), s.std(ddof=1), 25)
    with pytest.raises(Exception, match="a subsample of 38 is not possible with 37 clusters"):
        C.subsampled_sharpness(df, "x", "ok", [38], 5, by=["g"]).collect()


def test_hashed_weights_are_not_exploded(spark):
    """No row per cluster and draw: a task sends one row per draw; weights as in the statement, missing values too."""
    rows = [(i, None if i % 7 == 0 else i / 8) for i in range(2000)]
    sums = S.text_hash_sums(spark.createDataFrame(rows, "cluster bigint, v double").repartition(3), "v", 5, rows=900)
    assert "Generate" not in sums._jdf.queryExecution().optimizedPlan().toString()
    got = {r.b: (r.s, r.w) for r in sums.collect()}
    for b in range(5):
        h = [int(hashlib.md5(f"{b}|{i}".encode()).hexdigest()[:8], 16) for i, _ in rows]
        w = [0 if x < 1579999999 else 1 if x < 3159999999 else 2 for x in h]
        assert got[b] == (sum(x * v for x, (_, v) in zip(w, rows) if v is not None), sum(w))


def test_bm25_search_makes_no_row_per_shared_term(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefghij") for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(300)] + [None, "", "zz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    queries = spark.createDataFrame([("q1", "a b b C!"), ("q2", "zz"), ("q3", "none of these"), ("q4", None), ("q5", "j i h g f e d c b a")], "query string, text string")
    key = lambda df: sorted((r.query, r.pos, r.doc_id, round(r.score, 6)) for r in df.collect())
    got = Q.bm25_search(docs, queries, 6, block=2, rows=50)
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert key(got) == key(Q.bm25_retrieve(Q.bm25_index(docs, queries=queries), queries, 6))
    assert Q.bm25_search(docs, queries.where("query = 'q4'"), 6).count() == 0


def test_rerank_rounds_a_score_once(spark):
    first = spark.createDataFrame([("q", 1, 5, 0.4999999996e-6), ("q", 2, 4, 0.4999999999e-6), ("q", 3, 3, 0.1)], "query string, pos int, doc_id int, score double")
    got = [(r.doc_id, r.score) for r in Q.rerank(first, F.col("score"), 3, 3).orderBy("pos").collect()]
    assert got == [(3, 0.1), (4, 0.4999999999e-6), (5, 0.4999999996e-6)]  # equal to 9 digits: by id; the score as it is


def test_token_draws_are_sums_over_clusters(spark):
    """The sums of the step before, for every draw, from one weight per row and draw."""
    rng = np.random.default_rng(6)
    rows = [(i % 3, float(x), f"c{i % 40}", rng.integers(0, 2, i % 4).tolist()) for i in range(300) for x in (1, 2)]
    df = spark.createDataFrame(rows, "g int, x double, cluster string, ok array<int>").repartition(4)
    key = lambda rows: {tuple(r[c] for c in ("g", "x", "len", "j", "b")): (r.n, r.s) for r in rows}
    got = key(C._token_draws(df, ["g", "x"], 70, 5, size=100).collect())
    whole, at = C._token_sums(df, ["g", "x", "cluster"])
    for sums, own in ((whole, ["len"]), (at, ["len", "j"])):
        want = S.poisson_sums(sums, ["g", "x", *own], ["n", "s"], 70, 5)
        want = want.unionByName(sums.groupBy("g", "x", *own).agg(F.sum("n").cast("double").alias("n"), F.sum("s").alias("s")).withColumn("b", F.lit(-1)))
        want = key((want if "j" in own else want.withColumn("j", F.lit(None).cast("int"))).collect())
        assert want and all(got.pop(k) == v for k, v in want.items())
    assert not got


def test_poisson_weights_by_first_bits(spark):
    h = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    with np.errstate(over="ignore"):
        z = h[None, :] + (np.arange(9, dtype=np.uint64)[:, None] + np.uint64(3) * np.uint64(1 << 32) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
    assert (S.poisson_weights(h, np.arange(9, dtype=np.uint64), 3) == np.searchsorted(S.POISSON_STEPS, (z >> np.uint64(11)) * 2.0**-53)).all()


def test_longest_matches_shuffle_nothing_where_a_side_is_small(spark):
    """One scan, where there had been a round of semi joins per bit of the cap."""
    frame = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "name int, seq string")
    found = N.longest_match(frame("abcdef", "xyz", ""), frame("bcd"), 64)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {r.name: r.longest_match for r in found.collect()} == {0: 3, 1: 0, 2: 0}


def test_overlaps_shuffle_nothing_where_a_side_is_small(spark):
    frame = lambda *rows: spark.createDataFrame(list(enumerate(rows)), "name int, seq string")
    found = N.ngram_overlap(frame("abcab", "xyz", "a"), frame("abx"), 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert {r.name: r.overlap for r in found.collect()} == {0: 1 / 3, 1: 0, 2: None}


def test_large_groups_are_drawn_in_pieces_of_one_stream(spark, monkeypatch):
    """Intervals to the last bit where no task draws a group alone: numbers refused on the way, groups of NULL, small groups."""
    k = {None: 300_001, 1: 262_147, 2: 50, 3: 1}
    value = lambda n: (np.arange(n) * 7919 % 10007 - 4000) / 8
    rows = ["id AS cluster", "(id * 7919 % 10007 - 4000) / 8 AS v"]
    df = spark.range(300_001).selectExpr("CAST(NULL AS INT) AS g", *rows)
    for g in (1, 2, 3):
        df = df.union(spark.range(k[g]).selectExpr(f"{g} AS g", *rows))
    df = df.repartition(5)
    assert sum(S._refused(300_001, 4, i << 16, 1 << 16) for i in range(20)) > 20
    whole = S.summarize(df, "v", ["g"], n_boot=6, seed=4).orderBy("g").collect()
    monkeypatch.setattr(S, "ALONE", 1 << 19)
    monkeypatch.setattr(S, "STRETCH", 1 << 16)
    monkeypatch.setattr(S, "PIECE", 600_002)
    drawn, replicates = [], S._replicates
    monkeypatch.setattr(S, "_replicates", lambda spark, path, sizes, *a: drawn.extend(sizes) or replicates(spark, path, sizes, *a))
    got = {r.g: r for r in S.summarize(df, "v", ["g"], n_boot=6, seed=4).collect()}
    assert sorted(drawn) == [262_147, 300_001]
    for g, n in k.items():
        want = S.interval(*S.mean_replicates(value(n), 6, 4), 0.05, "bca") if n > 1 else dict.fromkeys(("lo", "hi", "se"))
        assert [got[g][c] for c in ("lo", "hi", "se")] == [want[c] for c in ("lo", "hi", "se")] and got[g].n_clusters == n
    assert all(got[r.g][c] == r[c] for r in whole for c in ("lo", "hi", "se", "ci_method", "caveats"))
    alone = S.cluster_bootstrap(df.where("g = 1"), "v", n_boot=6, seed=4, method="percentile").first()
    want = S.interval(*S.mean_replicates(value(k[1]), 6, 4), 0.05, "percentile")
    assert {c: alone[c] for c in want} == want and (alone.n_clusters, alone.n_rows) == (k[1], k[1])
    pairs = df.where("g IS NULL").selectExpr("cluster", "explode(map('a', v, 'b', IF(cluster % 3 = 0, NULL, 1.0D))) AS (c, v)")
    pair = S.paired_bootstrap(pairs, "v", "c", "a", "b", n_boot=6, seed=4).first()
    x = value(k[None])
    x = (x - 1.0)[np.arange(len(x)) % 3 > 0]
    want = S.interval(*S.mean_replicates(x, 6, 4), 0.05, "bca")
    assert {c: pair[c] for c in want} == want and (pair.n_clusters, pair.n_rows, pair.n_unpaired, pair.p) == (len(x), 2 * len(x), k[None] - len(x), 1 / 6)
