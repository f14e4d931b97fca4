import hashlib

import pytest
from pyspark.sql import functions as F

from plumbline.operators import accounting as A
from plumbline.operators.compare import assert_same, mismatches
from plumbline.plans import execution as X
from plumbline.plans import generators as B
from plumbline.plans import grid as P
from plumbline.plans import identity as I
from plumbline.plans.experiment import ConfigError, Experiment, build, from_config
from plumbline.sources import jsonl as J
from plumbline.sources import tasks as T

ROWS = "unit_id string, model string, status string, error string"


def test_six_states(spark):
    plan = spark.createDataFrame([(f"q{i}", "m") for i in range(7)], "unit_id string, model string")
    rows = [("q0", "m", "ok", None), ("q5", "m", None, None), ("q1", "m", "truncated", None), ("q2", "m", "unparsed", None), ("q3", "m", "error", "x"), ("q4", "m", None, "x")]
    r = A.attrition(spark.createDataFrame(rows, ROWS), ["model"], plan).first()
    assert (r.n_planned, r.n_completed, r.n_err, r.n_truncated, r.n_unparsed, r.n_missing, r.n_rows, r.n_unplanned) == (7, 2, 2, 1, 1, 1, 6, 0)
    assert r.attrition_rate == pytest.approx(5 / 7) and r.err_rate == pytest.approx(2 / 6)


def test_worst_row_decides_and_stale_plans_show(spark):
    plan = spark.createDataFrame([("a", "m1"), ("b", "m1"), ("c", None), ("d", "m3")], "unit_id string, model string")
    rows = [("a", "m1", "ok", None), ("a", "m1", "unparsed", None), ("b", "m1", "tool_error", "t"), ("b", "m1", "truncated", None), ("c", None, "ok", None), ("x", "m9", "ok", None), ("y", "m9", "ok", None)]
    got = {r.model: r for r in A.attrition(spark.createDataFrame(rows, ROWS), ["model"], plan).collect()}
    assert (got["m1"].n_unparsed, got["m1"].n_tool_error, got["m1"].n_rows) == (1, 1, 4)
    assert got[None].n_completed == 1 and got["m3"].n_missing == 1 and got["m3"].err_rate is None and got["m3"].missing_rate == 1
    assert got["m9"].n_planned == 0 and got["m9"].n_unplanned == 2 and got["m9"].attrition_rate is None
    for r in got.values():
        assert r.n_planned == r.n_completed + r.n_err + r.n_tool_error + r.n_truncated + r.n_unparsed + r.n_missing


def test_blind_and_unknown(spark):
    r = A.attrition(spark.createDataFrame([("a", "m", None, "e"), ("b", "m", None, None)], ROWS), ["model"]).first()
    assert (r.n_rows, r.n_err, r.err_rate) == (2, 1, 0.5)
    with pytest.raises(Exception, match="status"):
        A.attrition(spark.createDataFrame([("a", "m", "odd", None)], ROWS), ["model"]).collect()
    with pytest.raises(ValueError, match="scored"):
        A.attrition(spark.createDataFrame([("a", "m", "ok", None)], ROWS), ["model"], spark.createDataFrame([("a",)], "unit_id string"))


def test_row_status(spark):
    rows = [("ok", "e"), ("tool_error", "e"), ("error", None), ("ok", None), (None, "e"), (None, None)]
    got = [r.s for r in spark.createDataFrame(rows, "status string, error string").select(A.row_status(F.col("status"), F.col("error")).alias("s")).collect()]
    assert got == ["error", "tool_error", "error", "ok", "error", "ok"]


def test_first_and_last(spark):
    df = spark.createDataFrame([("u1", 2, "second"), ("u1", 1, "first"), (None, 3, "none"), ("u2", 1, None)], "unit_id string, seq int, v string")
    assert {(r.unit_id, r.v) for r in A.latest_rows(df).collect()} == {("u1", "second"), ("u2", None)}
    assert {(r.unit_id, r.v) for r in A.first_rows(df).collect()} == {("u1", "first"), ("u2", None)}


def test_job_status(spark):
    plan = spark.createDataFrame([("a",), ("b",)], "unit_id string")
    state = lambda rows: A.job_status(plan, spark.createDataFrame(rows, "unit_id string, status string")).first().job_status
    assert state([("a", "ok")]) == "incomplete" and state([("a", "ok"), ("b", "unparsed")]) == "complete" and state([("a", "ok"), ("b", "error")]) == "complete_with_errors"


def test_identity(spark):
    assert I.canonical({"b": 1, "a": [1.5, "é"]}) == '{"a":[1.5,"\\u00e9"],"b":1}'
    assert len(I.digest({})) == 32 and I.cell_id({"a": 1, "b": 2}) == I.cell_id({"b": 2, "a": 1})
    with pytest.raises(ValueError):
        I.canonical(float("nan"))
    units = spark.createDataFrame([("c", "i", 0)], "cell_id string, item_id string, repeat int")
    assert I.with_unit_ids(units).first().unit_id == I.unit_id("c", "i", 0)
    shards = {r.s for r in spark.range(200).select(I.shard_of(F.col("id").cast("string"), 7).alias("s")).collect()}
    assert shards == set(range(7))
    assert I.request_key({"messages": "x", "target": None}, "b") == I.request_key({"messages": "x"}, "b") != I.request_key({"messages": "x"}, "b", 1)


def test_unit_order_of_the_published_rows():
    """Ids sort as the published snapshot's rows do."""
    cells = {m: I.cell_id({"model": m}) for m in ("weak", "strong")}
    order = sorted(((I.unit_id(cells[m], f"q{i}", 0), f"q{i}", m) for m in cells for i in range(24)))
    assert [o[1:] for o in order[:9]] == [("q16", "strong"), ("q11", "strong"), ("q19", "weak"), ("q23", "weak"), ("q10", "weak"), ("q22", "strong"), ("q21", "weak"), ("q12", "weak"), ("q14", "strong")]


def test_grid(spark):
    axes = {"model": ["a", "b"], "shots": [0, 4]}
    assert P.grid_of(spark, axes).count() == 4
    cells = P.grid_of(spark, axes, [{"model": "b", "shots": 4}], {"tag": "t"})
    assert cells.count() == 3 and cells.first().tag == "t"
    with pytest.raises(ValueError, match="no axes"):
        P.grid_of(spark, axes, [{"colour": 1}])
    with pytest.raises(ValueError, match="reserved"):
        P.grid_of(spark, {"status": [1]})


def test_units_and_resume(spark):
    items = spark.createDataFrame([("i0", None, 0), ("i1", "i0", 1)], "item_id string, parent_id string, item_seq int")
    plan = P.units(P.grid_of(spark, {"m": ["x", "y"]}), P.with_clusters(items), 2)
    rows = plan.orderBy("plan_seq").collect()
    assert [(r.m, r.item_id, r.repeat) for r in rows] == [(m, i, k) for m in "xy" for i in ("i0", "i1") for k in (0, 1)]
    assert {r.cluster for r in rows} == {"i0"} and P.limited(plan, 3).count() == 3 and P.check_units(plan, items) is plan
    with pytest.raises(ValueError, match="twice"):
        P.check_units(plan.union(plan), items)
    keyed = spark.createDataFrame([(u, "k") for u in "abcdef"], "unit_id string, request_key string")
    latest = [("b", "k", "boom", "v1", 1), ("c", "old", None, "v1", 1), ("d", "k", None, "v0", 1), ("e", "k", None, "v1", 1), ("f", "k", None, "v1", 8)]
    seen = spark.createDataFrame(latest, "unit_id string, request_key string, error string, score_version string, batch_size int")
    got = P.resume(keyed, seen, "v1", batch_size=1)
    assert {r.unit_id: r.decision for r in got.collect()} == {"a": "call", "b": "retry", "c": "stale", "d": "rescore", "e": "done", "f": "stale"}
    n = P.plan_counts(got).first()
    assert (n.n_units, n.to_go, n.retried, n.stale, n.rescored, n.done) == (6, 4, 1, 2, 1, 2)
    assert P.cost(got, spark.createDataFrame([("k",)], "request_key string"), 1000, 0, {"in": 2.0, "out": 0}).first().to_call == 0
    with pytest.raises(Exception, match="two contents"):
        P.one_content(spark.createDataFrame([("u", "a"), ("u", "b")], "unit_id string, c string"), "c").collect()


def test_sink_files(spark, tmp_path):
    path = str(tmp_path / "rows.jsonl")
    with open(path, "w") as f:
        f.write('{"unit_id":"a","seq":1,"error":"x"}\n\n{"unit_id":"a","seq":2}\n{"seq":3}\n{"unit_id":"b","se')
    lines = J.read_jsonl(spark, path, "unit_id string, seq bigint, error string").cache()
    assert J.count_bad(lines).first().n_bad == 1
    assert [(r.unit_id, r.seq, r.status) for r in J.to_frame(lines).collect()] == [("a", 2, "ok")]
    plan = spark.createDataFrame([("a", 0), ("b", 1)], "unit_id string, plan_seq bigint")
    there = J.read_manifest(spark, str(tmp_path / "plan"), plan.schema)
    assert there.count() == 0
    J.append_plan(plan, str(tmp_path / "plan"), there)
    J.append_plan(plan.union(spark.createDataFrame([("c", 2)], plan.schema)), str(tmp_path / "plan"), J.read_manifest(spark, str(tmp_path / "plan"), plan.schema))
    assert J.read_manifest(spark, str(tmp_path / "plan"), plan.schema).count() == 3
    assert J.shard_path("out/run.jsonl", 3, 16) == "out/run.shard-03-of-16.jsonl"
    a, b = spark.createDataFrame([("a", 1)], "unit_id string, x int"), spark.createDataFrame([("b", 2)], "unit_id string, y int")
    assert J.merge_shards([a, b]).count() == 2
    with pytest.raises(ValueError, match="two shards"):
        J.merge_shards([a, a])


def test_parse_log(spark):
    lines = spark.createDataFrame([("load s=3",), ("x score v=1.5",), ("score v=2",), ("",), ("what",)], "value string")
    got = J.parse_log(lines, {"load": r"load s=(?P<s>\d+)", "score": r"score v=(?P<v>[\d.]+)"})
    assert [r.event for r in got.collect()] == ["load", "score", "score", None]
    assert [r.v for r in got.where("event = 'score'").select(J.typed(F.col("fields")["v"]).alias("v")).collect()] == [1.5, 2.0]
    u = J.unmatched(got).first()
    assert (u.unmatched, u.examples) == (1, ["what"])


def test_tasks(spark, tmp_path):
    p = tmp_path / "t.json"
    p.write_text('{"data": [{"q": "2+2?", "answers": ["4", "four"], "k": 1}]}')
    items = T.load_tasks(spark, str(p), {"id": "k", "prompt": "q", "gold": "answers.-1"})
    assert [(r.id, r.prompt, r.gold) for r in items.collect()] == [("1", "2+2?", "four")]
    T.save_tasks(items, str(tmp_path / "saved.jsonl"))
    assert T.load_tasks(spark, str(tmp_path / "saved.jsonl")).first().gold == "four"
    for text, fault in (('[{"id":"a"}]', "exactly one"), ('[{"id":"a","prompt":"x"},{"id":"a","prompt":"x"}]', "twice"), ('[{"id":"a","prompt":"x","z":1}]', "unknown"), ('[{"prompt":"x"}]', "no id")):
        p.write_text(text)
        with pytest.raises(T.TaskFormatError, match=fault):
            T.load_tasks(spark, str(p))
    (tmp_path / "c.jsonl").write_text('{"id":"d","text":"x"}\n{"id":"e","text":"y"}\n')
    assert T.load_corpus(spark, str(tmp_path / "c.jsonl")).count() == 2
    (tmp_path / "c.jsonl").write_text('{"id":"d","text":"x"}\n{"id":"d","text":"y"}\n')
    with pytest.raises(T.TaskFormatError, match="twice"):
        T.load_corpus(spark, str(tmp_path / "c.jsonl"))


def test_compare(spark):
    a = spark.createDataFrame([(1, 1.0, "x"), (2, None, "y")], "k int, v double, s string")
    assert_same(a, a.withColumn("v", F.col("v") * (1 + 1e-14)), ["k"])
    b = spark.createDataFrame([(1, 1.1, "x"), (3, None, "y")], "k int, v double, s string")
    assert {(r.k, r.column) for r in mismatches(a, b, ["k"]).collect()} == {(1, "v"), (2, "v"), (2, "s"), (3, "v"), (3, "s")}


def test_sums_match_the_published_items(spark):
    made = list(B.sums(digits=2, n_items=12, seed=3))
    whole = "\n\n".join(i["prompt"] + i["target"] for i in made)
    assert hashlib.sha256(whole.encode()).hexdigest() == "55c80648c298004bc2373616f91285e4aaea7ce2da8ddff3daeaaf213f62a230" and made[0]["id"] == "+d2s4-3-00000"
    assert B.leak_rate(B.sum_items(spark, n_items=50)).first().leak_rate == 0


def test_traces(spark):
    spans = B.traces(spark, 12, seed=1).cache()
    rows = {(r.trace, r.id): r for r in spans.collect()}
    assert all(rows[r.trace, r.parent].start_ms <= r.start_ms and r.end_ms <= rows[r.trace, r.parent].end_ms for r in rows.values() if r.parent)
    q = {(r.trace, r.type): r.gold for r in B.trace_questions(spans).collect()}
    for t in {k[0] for k in rows}:
        body = [r for (x, _), r in rows.items() if x == t and r.parent]
        assert q[t, "any_fail"] == ("yes" if any(r.status == "error" for r in body) else "no")
        ms = sorted((r.end_ms - r.start_ms for r in body), reverse=True)
        if ms[0] != ms[1]:
            assert q[t, "slowest"] == max(body, key=lambda r: r.end_ms - r.start_ms).name
        failed = [r for r in body if r.status == "error"]
        if failed:
            assert q[t, "failed_ids"].split(",") == sorted(r.id for r in failed) and q[t, "first_fail"] == min(failed, key=lambda r: (r.end_ms, r.id)).name
    logs = {r.trace: r.text.split("\n") for r in B.trace_log(spans).collect()}
    assert all(len(v) == 2 * sum(k[0] == t for k in rows) and v == sorted(v, key=lambda x: x[:9]) for t, v in logs.items())
    assert all(r.text.count("\n") + 1 == sum(k[0] == r.trace for k in rows) for r in B.trace_tree(spans).collect())


def test_world(spark):
    facts, docs = B.world(spark, 10)
    q = B.world_questions(facts).collect()
    assert docs.count() == 25 and len(q) == 25 and {r.type for r in q} == {"pop", "river_pop", "person_river"}
    text = {r.doc_id: r.text for r in docs.collect()}
    assert all(f"{int(r.gold):,}" in text[r.gold_docs[-1]] for r in q if r.type == "pop")


def test_a_run_resumes(spark, tmp_path):
    def flaky(request):
        if request["prompt"].endswith("3"):
            raise ValueError("three")
        return request["prompt"][-1]

    items = spark.createDataFrame([(f"q{i}", f"say {i}", str(i), "exact") for i in range(6)], "id string, prompt string, gold string, grader string")
    make = lambda backend: Experiment(items, {"model": ["a", "b"]}, backend, f"file://{tmp_path}/run", {"exact": "exact"}, prices={"in": 1.0, "out": 1.0}, max_cost=100.0)
    first = make(X.Function(flaky)).run()
    rows = first["rows"].collect()
    assert len(rows) == 12 and sum(r.status == "error" for r in rows) == 2 and sum(r.correct == 1 for r in rows) == 10
    assert {r.model: r.n_err for r in first["tables"]["attrition"].collect()} == {"a": 1, "b": 1} and first["job"]["job_status"] == "complete_with_errors"
    calls = spark.sparkContext.accumulator(0)

    def counted(request):
        calls.add(1)
        return request["prompt"][-1]

    second = make(X.Function(counted)).run()
    assert calls.value == 2 and all(r.status == "ok" for r in second["rows"].collect()) and second["job"]["job_status"] == "complete"
    assert not X.never_tried(second["plan"], second["rows"]).count() and (tmp_path / "run" / "run.json").exists()
    cheap = Experiment(items, {"model": ["a"]}, X.Echo(), f"file://{tmp_path}/other", {"exact": "exact"}, prices={"in": 1e6, "out": 0.0}, max_cost=0.1).run()
    assert "halted" in cheap and "rows" not in cheap


def test_backends():
    waits = []
    answers = iter([X.Transient("busy", 7.0), X.Transient("busy"), None])

    def call():
        e = next(answers)
        if e:
            raise e
        return [{"text": "done"}]

    assert X.with_retries(call, 1, sleep=waits.append) == [{"text": "done"}] and waits[0] == 7 and 0 <= waits[1] <= 2
    assert X.with_retries(lambda: (_ for _ in ()).throw(X.Fatal("no")), 2) == [{"error": "Fatal: no"}] * 2
    assert X.check_backend(X.Echo()) == []
    steps = X.Function(lambda r: {"text": "7"} if "add: 7" in r["prompt"] else {"text": "", "tool_calls": [{"name": "add", "arguments": {"a": 3, "b": 4}}]})
    assert X.Agent(steps, {"add": lambda a: str(a["a"] + a["b"])}).complete([{"prompt": "3+4"}])[0]["text"] == "7"
    assert X.Agent(steps, {}).complete([{"prompt": "3+4"}])[0]["tool_error"]
    assert X.derive(X.Calibration(latency_s=2.0, limits={"requests": 300}))["workers"] == 8
    assert X.derive(X.calibrate(X.Echo(), [{"prompt": "x"}] * 4))["batch_size"] in (1, 2, 4)


def test_config(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"task": {"name": "arithmetic", "n_items": 4}, "backend": "echo", "axes": {"m": ["x"]}, "out": "file://%s/o"}' % tmp_path)
    out = from_config(spark, str(tmp_path / "c.json")).run()
    assert out["rows"].count() == 4
    with pytest.raises(ConfigError, match="unknown"):
        build("task", {"name": "arithmetic", "nope": 1}, spark=spark)
    with pytest.raises(ConfigError, match="no backend"):
        build("backend", "telepathy")
