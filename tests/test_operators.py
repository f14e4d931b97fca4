"""Judges, retrieval, graders, contamination, curves, events and streams by hand."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import graders as G
from plumbline.functions.text import edit_distance, error_kind, json_path, normalize
from plumbline.operators import contamination as N
from plumbline.operators import curves as C
from plumbline.operators import events as E
from plumbline.operators import judges as V
from plumbline.operators import retrieval as Q
from plumbline.streaming import live

VERDICTS = "answer string, cluster string, judge string, criterion string, verdict double, reference double"


def verdicts(spark, by, reference=None):
    n = len(next(iter(by.values())))
    y = reference or [None] * n
    return spark.createDataFrame([(f"a{i}", f"c{i}", j, "q", None if v is None else float(v), None if y[i] is None else float(y[i])) for j, vs in by.items() for i, v in enumerate(vs)], VERDICTS)


def test_error_rates(spark):
    r = V.judge_error_rates(verdicts(spark, {"A": [1, 1, 0, 1, 0, 0]}, [1, 1, 1, 0, 0, 0])).first()
    assert (r.tp, r.fn, r.fp, r.tn, r.n_pos, r.n_neg, r.k) == (2, 1, 1, 2, 3, 3, 6)
    assert r.alpha == r.beta == pytest.approx(1 / 3) and r.lam == pytest.approx(1 / 3)
    with pytest.raises(Exception, match="0 or 1"):
        V.judge_error_rates(verdicts(spark, {"A": [0.5]}, [1])).collect()


def test_debias(spark):
    df = spark.createDataFrame([(0.6, 0.01, 0.1, 0.0, 0.2, 0.0)], "m double, se_m double, alpha double, se_alpha double, beta double, se_beta double")
    r = V.debias(df).first()
    assert r.theta == pytest.approx(5 / 7) and r.se == pytest.approx(0.01 / 0.7) and r.attenuation == pytest.approx(0.49)
    with pytest.raises(Exception, match="discriminate"):
        V.debias(df.withColumn("alpha", F.lit(0.9))).collect()


def test_debiased_mean_refuses_shared_clusters(spark):
    cal = verdicts(spark, {"A": [1, 1, 0, 1, 0, 0]}, [1, 1, 1, 0, 0, 0])
    rates = V.judge_error_rates(cal)
    with pytest.raises(ValueError, match="both"):
        V.debiased_mean(cal, rates, cal)
    other = cal.withColumn("cluster", F.concat(F.lit("x"), "cluster"))
    assert V.debiased_mean(other, rates, cal, n_boot=50).first().m == 0.5


def test_agreement(spark):
    r = V.agreement(verdicts(spark, {"A": [1, 1, 0, 0], "B": [1, 0, 0, 0]})).first()
    assert (r.n, r.agreement, r.kappa, r.b, r.c, r.mcnemar_p) == (4, 0.75, 0.5, 1, 0, 1.0)
    r = V.agreement(verdicts(spark, {"A": [1, 1, 0], "B": [1, None, 0]})).first()
    assert (r.n, r.agreement) == (2, 1.0)
    twice = verdicts(spark, {"A": [1, 0], "B": [1, 0]})
    with pytest.raises(Exception, match="two rows"):
        V.agreement(twice.union(twice)).collect()


def test_error_correlation(spark):
    y = [1, 1, 0, 0]
    same = V.error_correlation(verdicts(spark, {"A": [0, 1, 0, 1], "B": [0, 1, 0, 1]}, y))
    assert same.first().rho == pytest.approx(1) and V.panel(same).first().n_eff == pytest.approx(1)
    opposite = V.error_correlation(verdicts(spark, {"A": [0, 1, 1, 0], "B": [1, 0, 0, 1]}, y))
    assert opposite.first().rho == pytest.approx(-1) and V.panel(opposite).first().n_eff == math.inf
    none = V.error_correlation(verdicts(spark, {"A": y, "B": [0, 1, 0, 0]}, y))
    assert none.first().rho is None and V.panel(none).first().rho_bar is None


def test_majority(spark):
    got = {r.answer: (r.panel, r.status, r.n_judges) for r in V.majority(verdicts(spark, {"A": [1, 0, 1], "B": [1, 0, None], "C": [0, 1, 1]}), ["A", "B", "C"]).collect()}
    assert got == {"a0": (1, "ok", 3), "a1": (0, "ok", 3), "a2": (None, "incomplete", 2)}
    with pytest.raises(ValueError, match="odd"):
        V.majority(verdicts(spark, {"A": [1]}), ["A", "B"])


def test_verdict_calls(spark):
    texts = ['[{"name":"verdict","arguments":{"ok":true,"safe":false}}]', '[{"name":"verdict","arguments":{"ok":true}}]', '[{"name":"verdict","arguments":{"ok":"yes","safe":true}}]', "[]"]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(V.parse_verdicts(F.col("t"), ["ok", "safe"]).alias("v")).collect()]
    assert got[0].asDict() == {"ok": True, "safe": False} and got[1:] == [None] * 3
    items = V.calibration_items(spark.createDataFrame([("a", 1210)], "answer string, gold int")).collect()
    assert {(r.variant, r.text, r.reference) for r in items} == {("plain", "1210", 1.0), ("separated", "1,210", 1.0), ("off_by_one", "1211", 0.0), ("swapped", "2110", 0.0)}


# == retrieval ==


def ranking(spark, names, query="q"):
    return spark.createDataFrame([(query, i + 1, d) for i, d in enumerate(names)], "query string, pos int, doc_id string")


def test_rank_metrics(spark):
    gold = spark.createDataFrame([("q", d) for d in "abcz"], "query string, doc_id string")
    r = Q.rank_metrics(ranking(spark, "axbyc"), gold, (1, 3, 5)).first()
    assert (r["recall@1"], r["recall@3"], r["recall@5"], r.rr) == (0.25, 0.5, 0.75, 1)
    assert r["ndcg@3"] == pytest.approx(1.5 / (1.5 + 1 / math.log2(3)))
    again = Q.rank_metrics(ranking(spark, "xxxa"), gold, (2,)).first()
    assert again["recall@2"] == 0.25 and again.rr == 0.5
    graded = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 1.0), ("q", "c", 0.0)], "query string, doc_id string, gain double")
    r = Q.rank_metrics(ranking(spark, "bca"), graded, (3,)).first()
    assert r["ndcg@3"] == pytest.approx((1 + 3 / 2) / (3 + 1 / math.log2(3))) and r["recall@3"] == 1
    r = Q.rank_metrics(ranking(spark, "x"), gold.limit(0), (1,)).first()
    assert r["recall@1"] is None and r.rr is None


def test_bm25(spark):
    docs = spark.createDataFrame([("d1", "the cat sat"), ("d2", "the dog sat on the dog mat"), ("d3", "a bird")], "doc_id string, text string")
    ask = lambda *q: spark.createDataFrame([(x, x) for x in q], "query string, text string")
    got = {r.doc_id: r.score for r in Q.bm25_score_all(Q.bm25_index(docs), ask("dog"), docs).collect()}
    want = math.log(1 + 2.5 / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 7 / 4))
    assert got["d1"] == got["d3"] == 0 and got["d2"] == pytest.approx(want)
    ties = spark.createDataFrame([("b", "x y"), ("a", "x y"), ("c", "z")], "doc_id string, text string")
    assert [r.doc_id for r in Q.bm25_retrieve(Q.bm25_index(ties), ask("x", "q"), 5).orderBy("pos").collect()] == ["a", "b"]


def test_dense(spark):
    docs = spark.createDataFrame([(i, [float(i % 3), 1.0, 0.0]) for i in range(30)], "doc_id bigint, vector array<float>")
    queries = spark.createDataFrame([(0, [0.0, 2.0, 0.0]), (1, [9.0, 1.0, 0.0])], "query bigint, vector array<float>")
    for block in (1, 100):
        got = Q.dense_search(docs, queries, 3, block=block).orderBy("query", "pos").collect()
        assert [r.doc_id for r in got] == [0, 3, 6, 2, 5, 8]
    c = Q.ivf_fit(docs, 3)
    assert all(r.recall == 1 for r in Q.ann_recall(Q.ivf_search(Q.ivf_index(docs, c), c, queries, 3, 3), Q.dense_search(docs, queries, 3), 3).collect())
    made = []
    texts = spark.createDataFrame([("doc", "a"), ("doc", "a"), ("query", "a")], "role string, text string")
    out = Q.embed_distinct(texts, lambda t: np.array([[len(x), 1.0] for x in t]))
    made.append(out.count())
    assert made == [2] and Q.embed_distinct(texts, lambda t: 1 / 0, out).count() == 2


def scores(spark):
    return spark.createDataFrame([("q", "a", 0.0), ("q", "b", 0.5), ("q", "c", 1.0), ("q", "d", 2.0)], "query string, doc_id string, score double")


def test_gold_controls(spark):
    gold = lambda names: spark.createDataFrame([("q", n) for n in names], "query string, doc_id string")
    order = lambda df: [r.doc_id for r in df.orderBy("pos").collect()]
    assert order(Q.gold_control(scores(spark), gold("ac"), "oracle", 3)) == ["c", "a", "d"]
    assert order(Q.gold_control(scores(spark), gold("d"), "removed", 3)) == ["c", "b", "a"]
    assert order(Q.gold_control(scores(spark), gold("a"), "none", 2)) == ["d", "c"]
    with pytest.raises(Exception, match="not in the corpus"):
        Q.gold_control(scores(spark), gold("z"), "none", 3).collect()
    with pytest.raises(Exception, match="more gold"):
        Q.gold_control(scores(spark), gold("abc"), "oracle", 2).collect()


def test_sampling(spark):
    base = scores(spark).withColumn("score", F.expr("CASE doc_id WHEN 'a' THEN 1.0 WHEN 'b' THEN 1.0 WHEN 'c' THEN 0.5 ELSE 2.0 END"))
    assert [r.doc_id for r in Q.sampled_ranking(base, 3, math.inf).orderBy("pos").collect()] == ["d", "a", "b"]
    many = spark.range(3000).select(F.col("id").cast("string").alias("query")).crossJoin(scores(spark).drop("query"))
    first = {r.doc_id: r.n / 3000 for r in Q.sampled_ranking(many, 1, 1.0, 3).groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    weight = {d: math.exp(s) for d, s in zip("abcd", (0, 0.5, 1, 2))}
    assert all(abs(first[d] - w / sum(weight.values())) < 0.035 for d, w in weight.items())


def test_rerank(spark):
    first = Q.top(scores(spark), 4)
    assert [r.doc_id for r in Q.rerank(first, -F.col("score"), 2, 3).orderBy("pos").collect()] == ["b", "c"]


# == graders ==


@pytest.mark.parametrize(
    ("spec", "text", "gold", "correct"),
    [
        ("exact", "  The  Answer! ", "the answer", 1), ("exact", "no", "yes", 0), ({"name": "exact", "extract": "Answer: (.*)"}, "x\nAnswer: 5", "5", 1), ({"name": "exact", "extract": "Answer: (.*)"}, "5", "5", None),
        ({"name": "exact", "case": True}, "Yes", "yes", 0), ("contains", "it is Paris.", "paris", 1), ("exact", "  ", "x", None), ("exact", None, "x", None),
        ("numeric", "1,234 and 2,3", "3", 1), ({"name": "numeric", "pick": "first"}, "1,234 and 2", "1234", 1), ({"name": "numeric", "tol": 0.5}, "about -0.5 or .7", "1", 1), ("numeric", "none", "1", None), ({"name": "numeric", "rel": 0.1}, "95", "100", 1),
        ("choice", "The answer is (c).", "C", 1), ("choice", "Answer: B", "C", 0), ("choice", "A good question, so B or C", "B", None), ("choice", "the answer is a tricky one, but B", "B", 1), ("choice", "I pick D", "D", 1), ("choice", "none", "A", None),
        ("yes_no", "Well, YES.", "yes", 1), ("yes_no", "yes and no", "yes", None), ("yes_no", "I know", "no", None),
        ("abstain", "It is not mentioned here", "", 1), ("abstain", "It is 5", "", 0), ({"name": "label", "options": ["cat", "cats"]}, "The CATS", "cats", 1), ({"name": "label", "options": ["cat", "dog"]}, "cat or dog", "cat", None),
        ({"name": "numeric", "abstain": True}, "I cannot find 5", "5", 0), ({"name": "numeric", "abstain": True}, "5", "5", 1),
    ],
)
def test_graders(spark, spec, text, gold, correct):
    df = spark.createDataFrame([(text, gold)], "text string, gold string")
    g = df.select(G.grade(spec, F.col("text"), F.col("gold")).alias("g")).first().g
    assert (g.correct if g is not None else None) == correct


def test_set_f1_and_more(spark):
    df = spark.createDataFrame([("s1, s2 and s9", ["s1", "s2", "s3", "s4"])], "t string, g array<string>")
    r = df.select(G.set_f1(F.col("t"), F.col("g"), r"s\d").alias("x")).first().x
    assert (r.precision, r.recall, r.f1, r.n_pred, r.correct) == (pytest.approx(2 / 3), 0.5, pytest.approx(4 / 7), 3, 0)
    many = spark.createDataFrame([("Oslo", ["x", "oslo"])], "t string, g array<string>").select(G.exact(F.col("t"), F.col("g"), many=True).alias("x")).first().x
    assert many.correct == 1
    with pytest.raises(Exception, match="nothing"):
        df.select(G.exact(F.col("t"), F.lit("!?"))).collect()
    with pytest.raises(KeyError):
        G.grade("guess", F.col("t"), F.col("g"))
    with pytest.raises(ValueError, match="numeric"):
        G.grade({"name": "numeric", "colour": 1}, F.col("t"), F.col("g"))
    t = spark.createDataFrame([([True, False, True], [-1.0, -2.0, -0.5])], "ok array<boolean>, logp array<double>").select(G.score_teacher_forced(F.col("ok"), F.col("logp")).alias("x")).first().x
    assert (t.em_tf, t.tok_acc, t.sum_logp, t.n_target) == (0, pytest.approx(2 / 3), -3.5, 3)
    rows = spark.createDataFrame([("4", "4", "exact", None), ("", "4", "exact", None), ("4", "4", "exact", "error")], "text string, gold string, grader string, status string")
    assert [(r.correct, r.status) for r in G.score_rows(rows, {"exact": "exact"}).collect()] == [(1, "ok"), (None, "unparsed"), (None, "error")]


def test_text(spark):
    df = spark.createDataFrame([("HTTP 429 after 1.5s id deadbeef01234567", "kitten", "sitting", '{"a":{"b":[1,2]}}')], "m string, a string, b string, j string")
    r = df.select(error_kind(F.col("m")).alias("k"), edit_distance(F.col("a"), F.col("b")).alias("d"), json_path(F.col("j"), "a.b.-1", "int").alias("v"), json_path(F.col("j"), "a.x.0").alias("n"), normalize(F.lit(" A  b!")).alias("t")).first()
    assert (r.k, r.d, r.v, r.n, r.t) == ("HTTP # after #s id #", 3, 2, None, "a b")


# == contamination ==


def seqs(spark, **named):
    return spark.createDataFrame(list(named.items()), "name string, seq string")


def test_overlap(spark):
    got = {r.name: r.overlap for r in N.ngram_overlap(seqs(spark, x="abababzq", y="abzq", z="a"), seqs(spark, r="abcd"), 2).collect()}
    assert got == {"x": 0.25, "y": pytest.approx(1 / 3), "z": None}


def test_longest_match(spark):
    ref = seqs(spark, r="alpha beta gamma delta")
    assert N.longest_match(seqs(spark, c="QQQ beta gamma QQQ"), ref).first().longest_match == 12
    r = N.longest_match(seqs(spark, c="x" * 50, n="#"), seqs(spark, r="x" * 50), max_n=12).collect()
    assert {(x.name, x.longest_match, x.capped) for x in r} == {("c", 12, True), ("n", 0, False)}


def test_report(spark):
    out = N.contamination_report(seqs(spark, copied="the quick brown fox jumps", own="nothing to see here"), seqs(spark, r="the quick brown fox jumps over"), seqs(spark, c="a wolf walks by").select("seq"), (4,), 32)
    got = {r.name: r for r in out.collect()}
    assert got["copied"].overlap_4_excess > 0.9 and got["copied"].longest_match == 25 and got["control"].overlap_4_excess == 0 and got["control"].is_control
    with pytest.raises(Exception, match="reserved"):
        N.contamination_report(seqs(spark, control="x"), seqs(spark, r="y"), None, (1,), 2).collect()


# == curves ==


def test_value_curve(spark):
    rows = [(x, f"i{i}", f"i{i}", math.log10(x) / 2 + s) for x in (1, 10, 100) for i, s in enumerate((0, 0.25))] + [(1, "lost", "lost", 1.0)]
    df = spark.createDataFrame(rows, "x int, item_id string, cluster string, v double")
    curve = C.value_curve(df, "x", "v").orderBy("x").collect()
    assert [r.mean for r in curve] == pytest.approx([0.125, 0.625, 1.125]) and [r.chi for r in curve] == pytest.approx([0.5 / math.log(10)] * 3)
    n = C.n_dropped(df, "x", F.lit(True)).first()
    assert (n.n_items, n.n_dropped) == (2, 1)
    only = lambda i: C.crossing(C.value_curve(df.where(F.col("item_id") == i), "x", "v"), "mean", 0.5).first().crossing
    assert only("i0") == pytest.approx(10) and only("i1") == pytest.approx(math.sqrt(10))
    assert C.crossing(C.value_curve(df, "x", "v"), "mean", 9.0).first().crossing is None
    got = {(r.quantity, r.x): r for r in C.value_curves(df, "x", "v", levels=[0.5, 9.0], n_boot=50).collect()}
    assert got["mean", 10.0].point == pytest.approx(0.625) and got["crossing_9", None].censored == 1 and got["crossing_9", None].point is None
    text = C.curve_caveats(C.value_curves(df, "x", "v", levels=[9.0], n_boot=20), 2).first().caveats
    assert "only 2 clusters" in text and "never reaches" in text
    with pytest.raises(Exception, match="0 or less"):
        C.value_curve(df.withColumn("x", F.col("x") - 1), "x", "v").collect()
    with pytest.raises(Exception, match="two rows"):
        C.value_curve(df.union(df), "x", "v").collect()
    with pytest.raises(ValueError, match="numeric"):
        C.value_curve(df.withColumn("x", F.col("x").cast("string")), "x", "v")


def test_gradient_is_numpys(spark):
    x, y = [1.0, 2.0, 5.0, 9.0], [0.3, 0.1, 0.7, 0.2]
    df = spark.createDataFrame(list(zip(x, y)), "x double, y double")
    got = [r.chi for r in C.susceptibility(df, "y", log_x=False).orderBy("x").collect()]
    assert got == pytest.approx(list(np.gradient(np.array(y), np.array(x))))
    p = C.peak(C.susceptibility(df, "y", log_x=False)).first()
    assert p.peak_x == x[int(np.argmax(got))]


def test_composition(spark):
    ok = [list(map(int, s)) for s in "1 0 11 10 01 11".split()]
    rows = [(x, f"i{i}", f"i{i}", seq) for x in (1, 2) for i, seq in enumerate(ok)]
    df = spark.createDataFrame(rows, "x int, item_id string, cluster string, ok array<int>")
    for r in C.composition_points(df, "x", "ok").collect():
        assert (r.A_obs, r.p, r.A_pred, r.phi, r.A_pred_lc, r.phi_lc) == pytest.approx((1 / 2, 0.7, 5 / 9, -1 / 18, 13 / 24, -1 / 24))
    got = {(r.quantity, r.x): r.point for r in C.axis_curves(df, "x", "ok", n_boot=30).collect()}
    assert got["phi_l2", 1.0] == pytest.approx(-1 / 16) and got["phi_l1", 2.0] == pytest.approx(0) and got["A_pred", 1.0] == pytest.approx(5 / 9)
    s = C.subsampled_sharpness(df, "x", "ok", [2, 6], 20).collect()
    assert [r.m for r in s] == [2, 6] and s[1].s_sd == pytest.approx(0)
    t = C.explode_tokens(df.withColumn("other", F.col("ok")), ["ok", "other"])
    assert t.count() == 20 and t.where("position = 1").count() == 8


# == events ==

EVENTS = "t timestamp, event string, unit_id string, status string, error string, latency_s double, in_tokens double, out_tokens double, n_units bigint, to_go bigint, reason string, wait_s double"


def log(spark, rows):
    base = {"unit_id": None, "status": None, "error": None, "latency_s": None, "in_tokens": None, "out_tokens": None, "n_units": None, "to_go": None, "reason": None, "wait_s": None}
    names = [c.strip().split(" ")[0] for c in EVENTS.split(",")]
    df = spark.createDataFrame([tuple(({"s": s, "event": e} | base | kw).get("s" if n == "t" else n) for n in names) for s, e, kw in rows], EVENTS.replace("t timestamp", "t double", 1))
    return df.withColumn("t", F.timestamp_micros((F.col("t") * 1000000).cast("bigint")))


def test_runs_and_stalls(spark):
    rows = [(0.0, "run_start", {"n_units": 3, "to_go": 3}), (0.0, "unit", {"status": "ok", "latency_s": 1.0, "in_tokens": 10.0}), (5.0, "unit", {"status": "error", "error": "HTTP 429 wait 3"}), (900.0, "unit", {"status": "error", "error": "HTTP 500 wait 9", "latency_s": 3.0}),
            (1000.0, "run_start", {"n_units": 1, "to_go": 1}), (8000.0, "unit", {"status": "ok"}), (8001.0, "run_end", {}), (8002.0, "retry", {"reason": "busy 3", "wait_s": 2.0})]
    e = log(spark, rows).cache()
    a, b = E.runs(e).orderBy("run").collect()
    assert (a.ended, a.elapsed_s, a.planned, a.units_done, b.ended, b.elapsed_s) == (False, 900.0, 3, 3, True, 7001.0)
    assert sorted(r.gap_s for r in E.stalls(e).collect()) == [895.0, 7100.0]
    assert [(r.kind, r.n) for r in E.error_kinds(e).collect()] == [("HTTP # wait #", 2)]
    assert (E.latency(e).first().median, E.tokens(e, {"in": 2.0, "out": 1.0}).first().cost) == (2.0, 20 / 1e6)
    assert E.retries(e).first().asDict() == {"kind": "busy #", "n": 1, "wait_s": 2.0, "server_requested": 0}
    assert "stalls:" in E.format_summary(E.summarize_events(e)) and E.throughput(e).first().max == 2


def test_streams(spark, tmp_path):
    e = log(spark, [(float(s), "unit", {"unit_id": str(s % 2)}) for s in (0, 10, 310, 611, 70)])
    e.select("t", "unit_id").coalesce(1).write.parquet(str(tmp_path / "e"))
    minutes = live.drain(live.per_minute(live.file_stream(spark, str(tmp_path / "e"))), "m1")
    assert sorted(r.n for r in minutes.collect()) == [1, 1, 1, 2]
    assert live.drain(live.sessions(live.file_stream(spark, str(tmp_path / "e"))), "s1").count() == 2  # 0 to 310 with a gap under 300, then 611
    write = live.upsert_into(str(tmp_path / "up"), "k", "seq")
    for epoch, rows in enumerate(([("a", 1, "x"), ("b", 1, "y")], [("a", 2, "z"), ("b", 0, "late")])):
        write(spark.createDataFrame(rows, "k string, seq int, v string"), epoch)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "up/v=1")).select("k", "v").collect()} == {("a", "z"), ("b", "y")}
