import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import floors as L
from plumbline.operators import statistics as S

ROWS = "g string, cluster string, y double"


def frame(spark, groups, schema=ROWS):
    return spark.createDataFrame([("all", c, float(v)) for c, vs in groups.items() for v in vs], schema)


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-12)


def test_icc_by_hand(spark):
    r = S.effective_n(frame(spark, {"a": [1], "b": [0, 2], "c": [4, 4, 7]}), "y", ["g"]).first()
    assert close(r.ms_between, 12) and close(r.ms_within, 8 / 3) and close(r.m0, 11 / 6)
    assert close(r.rho, 21 / 32) and close(r.deff, 99 / 64) and close(r.n_eff, 128 / 33)


def test_icc_is_clipped(spark):
    r = S.effective_n(frame(spark, {"a": [0, 2], "b": [0, 2]}), "y").first()
    assert (r.ms_between, r.ms_within, r.m0, r.rho, r.deff, r.n_eff) == (0, 2, 2, 0, 1, 4)


def test_no_replication(spark):
    r = S.effective_n(frame(spark, {f"c{i}": [i % 3] for i in range(30)}), "y", ["g"]).first()
    assert r.rho is None and (r.deff, r.n_eff) == (1, 30)


def test_cluster_mean_is_not_the_row_mean(spark):
    df = frame(spark, {"c0": [0, 0, 0], "c1": [1], "c2": [math.nan]})
    r = S.cluster_mean(df, "y", ["g"]).first()
    assert (r.point, r.n_clusters, r.n_rows, r.n_excluded) == (0.5, 2, 4, 1)


def test_value_without_cluster_is_refused(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", "c", 2.0)], ROWS)
    with pytest.raises(Exception, match="no cluster"):
        S.cluster_mean(df, "y", ["g"]).collect()
    assert S.cluster_mean(df.withColumn("y", F.when(F.col("cluster").isNotNull(), F.col("y"))), "y", ["g"]).first().n_excluded == 1


def golden_rows(spark):
    """24 items, the last 12 in the clusters of the first; two models right by a rule on the number."""
    rows = [(m, f"q{i % 12}", float(i % (3 if m == "strong" else 2) != 0 if m == "strong" else i % 2 == 0)) for m in ("weak", "strong") for i in range(24)]
    return spark.createDataFrame(rows, "model string, cluster string, correct double")


def test_summary_matches_published_numbers(spark):
    got = {r.model: r for r in S.summarize(golden_rows(spark), "correct", ["model"]).collect()}
    want = {"strong": (2 / 3, 1 / 3, 11 / 12, 0.13685544297302596), "weak": (0.5, 0.25, 0.75, 0.14401296585986986)}
    for m, numbers in want.items():
        r = got[m]
        assert (r.point, r.lo, r.hi, r.se) == pytest.approx(numbers, rel=1e-12)
        assert (r.n_clusters, r.n_rows, r.n_excluded, r.m0, r.rho, r.deff, r.n_eff, r.ci_method) == (12, 24, 0, 2, 1, 2, 12, "bca")
        assert r.caveats == "only 12 clusters: the interval is too narrow (a nominal 95% interval covers ~90% at k=10)"


def test_summary_of_small_null_and_lost_groups(spark):
    rows = [(None, "a", 1.0), (None, "b", 1.0), ("x", "a", 2.0), ("x", "a", 4.0), ("y", "a", None), ("y", "a", None)]
    got = {r.g: r for r in S.summarize(spark.createDataFrame(rows, ROWS), "y", ["g"], n_boot=50).collect()}
    assert got["x"].point == 3 and got["x"].lo is None and got["x"].ci_method.startswith("skipped") and got["x"].n_rows == 2
    assert got["y"].point is None and got["y"].n_excluded == 2 and "100% of rows have no value" in got["y"].caveats
    assert "no spread" in got[None].caveats and (got[None].lo, got[None].hi) == (1, 1)


def test_summary_with_floors(spark):
    df = golden_rows(spark).withColumn("label", F.col("correct").cast("string"))
    got = {r.model: r for r in S.summarize(df, "correct", ["model"], n_boot=200, label="label", floor={"stated": 0.1}).collect()}
    assert got["strong"].binding_floor == "majority" and close(got["strong"].floor_value, 2 / 3) and not got["strong"].above_floor_ci


def test_bootstrap_refuses_one_cluster_and_takes_any_statistic(spark):
    with pytest.raises(Exception, match="two clusters"):
        S.cluster_bootstrap(frame(spark, {"a": [1, 2]}), "y", ["g"]).collect()
    df = frame(spark, {f"c{i}": [i, i + 1] for i in range(9)})
    a = S.cluster_bootstrap(df, "y", ["g"], n_boot=300).first()
    b = S.cluster_bootstrap(df, "y", ["g"], n_boot=300, stat=np.mean).first()
    assert all(math.isclose(a[k], b[k], rel_tol=1e-9) for k in ("point", "lo", "hi", "se"))


def test_row_order_and_doubled_rows_change_nothing(spark):
    df = frame(spark, {f"c{i}": [i % 4, i % 3] for i in range(20)})
    a = S.cluster_bootstrap(df, "y", ["g"], n_boot=200).first()
    b = S.cluster_bootstrap(df.union(df).orderBy(F.desc("y")).repartition(3), "y", ["g"], n_boot=200).first()
    assert all(math.isclose(a[k], b[k], rel_tol=1e-12) for k in ("point", "lo", "hi", "se")) and b.n_rows == 2 * a.n_rows


def test_draws_in_chunks_are_the_same_stream(monkeypatch):
    x = np.arange(12.0)
    whole = S.mean_replicates(x, 100, 3)[1]
    monkeypatch.setattr(S, "DRAW_CELLS", 50)
    assert (S.mean_replicates(x, 100, 3)[1] == whole).all()
    assert np.allclose(S.mean_replicates(x, 1, 0)[2], [np.delete(x, i).mean() for i in range(12)])


def test_interval_covers(spark):
    rng, hits = np.random.default_rng(5), 0
    for _ in range(200):
        x = rng.normal(size=40) + np.repeat(rng.normal(size=1), 40) * 0
        r = S.interval(*S.mean_replicates(x, 800, 0), 0.05, "bca")
        hits += r["lo"] <= 0 <= r["hi"]
    assert 0.905 <= hits / 200 <= 0.99


def test_poisson_engine_agrees(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([("all", f"c{i}", float(v)) for i in range(300) for v in rng.normal(i % 5, 1, 3)], ROWS).repartition(5)
    a = S.summarize(df, "y", ["g"], n_boot=2000).first()
    b = S.summarize(df, "y", ["g"], n_boot=2000, engine="poisson").first()
    assert a.point == b.point and abs(a.se - b.se) < 0.1 * a.se and abs(a.lo - b.lo) < 0.3 * a.se and b.ci_method == "poisson"
    again = S.summarize(df.repartition(2), "y", ["g"], n_boot=2000, engine="poisson").first()
    assert math.isclose(again.lo, b.lo, rel_tol=1e-9)


def test_paired(spark):
    rows = [("a", c, 1.0 + i) for i, c in enumerate("pqr")] + [("b", c, 0.5) for c in "pqs"] + [("z", "p", 9.0)]
    df = spark.createDataFrame(rows, "cond string, cluster string, y double")
    p = S.paired_point(df, "y", "cond", "a", "b").first()
    assert (p.point, p.n_clusters, p.n_rows, p.n_unpaired) == (1.0, 2, 4, 2)
    r = S.paired_bootstrap(df, "y", "cond", "a", "b", n_boot=100).first()
    assert (r.n_clusters, r.n_rows, r.n_unpaired, r.p) == (2, 4, 2, 0.01)


def test_wilson(spark):
    z2 = NormalDist().inv_cdf(0.975) ** 2
    df = spark.createDataFrame([(0, 30), (30, 30), (0, 0)], "k int, n int")
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    a, b, c = df.select(lo.alias("lo"), hi.alias("hi")).collect()
    assert a.lo == 0 and close(a.hi, z2 / (30 + z2)) and close(b.lo, 30 / (30 + z2)) and b.hi == 1 and c.lo is None


def test_mcnemar(spark):
    pairs = [(0, 0), (1, 0), (5, 1), (10, 10), (3, 40)]
    got = [r.p for r in spark.createDataFrame(pairs, "b int, c int").select(S.mcnemar(F.col("b"), F.col("c")).alias("p")).collect()]
    want = [min(1.0, 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)) if b + c else 1.0 for b, c in pairs]
    assert np.allclose(got, want, rtol=1e-9)


@pytest.mark.parametrize(("p", "bh", "holm"), [("0.03 0.001 0.9 0.02 0.5", "TTFTF", "FTFFF"), ("0.044 0.040 0.043 0.041 0.042", "TTTTT", "FFFFF")])
def test_many_tests(spark, p, bh, holm):
    df = spark.createDataFrame(list(enumerate(map(float, p.split()))), "i int, p double")
    flags = lambda d: "".join("FT"[r.reject] for r in d.orderBy("i").collect())
    assert flags(S.benjamini_hochberg(df, "p")) == bh and flags(S.holm(df, "p")) == holm
    with pytest.raises(Exception, match="missing"):
        S.holm(df.union(spark.createDataFrame([(9, math.nan)], "i int, p double")), "p").collect()


def test_ratio_se(spark):
    se = lambda rows: spark.createDataFrame(rows, "n double, d double").agg(S.ratio_se(F.col("n"), F.col("d")).alias("s")).first().s
    assert close(se([(1.0, 2.0), (0.0, 1.0), (2.0, 2.0)]), math.sqrt(1.5 * 1.04) / 5)
    assert close(se([(1.0, 2.0), (0.0, 1.0), (2.0, 2.0), (0.0, 0.0)]), math.sqrt(4 / 3 * 1.04) / 5)
    assert se([(1.0, 3.0), (0.0, 0.0), (0.0, 0.0)]) is None


def test_floors(spark):
    df = spark.createDataFrame([(c,) for c in "a" * 60 + "b" * 30 + "c" * 10], "label string")
    got = {r.floor: r.value for r in L.floors(df, "label").collect()}
    assert close(got["majority"], 0.6) and close(got["prior_matched"], 0.46) and close(got["uniform"], 1 / 3)
    two = spark.createDataFrame([(c,) for c in "a" * 70 + "b" * 30], "label string")
    h = L.headroom(0.62, L.floors(two, "label", custom={"stated": 0.55})).first()
    assert h.binding_floor == "majority" and math.isclose(h.headroom, -0.08) and not h.above_floor
    h = L.headroom(1.692, L.floors(two, custom={"trigram": 1.784, "unigram": 1.90}, units="nats"), higher_is_better=False).first()
    assert h.binding_floor == "trigram" and math.isclose(h.headroom, 0.092, rel_tol=1e-9) and h.above_floor
    with pytest.raises(Exception, match="scale"):
        L.headroom(1.0, L.floors(two, "label", custom={"loss": 1.7}, units="nats")).collect()
