"""Runs in parts, their logs, tools, sidecars and shards; hashed draws against drawn ones."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import __main__ as cli
from plumbline.functions import hashed_sql as H
from plumbline.operators import curves as C
from plumbline.operators import judges as V
from plumbline.operators import retrieval as Q
from plumbline.operators import statistics as S
from plumbline.plans import execution as X
from plumbline.plans import experiment as E
from plumbline.plans import identity as I
from plumbline.plans import search_tools as T
from plumbline.sources import arrays as A
from plumbline.sources import jsonl as J

DOCS = {"a": "the red fox", "b": "a blue whale, red at heart", "c": "nothing here"}


def test_search_tools():
    corpus = T.CorpusSearch(DOCS, k=2)
    assert corpus.tool({"query": "RED fox"}) == "[a] the red fox\n\n[b] a blue whale, red at heart"
    assert corpus.tool({"query": "zebra"}) == "Nothing was found."
    with pytest.raises(T.ToolInputError):
        corpus.tool({"query": "?!"})
    assert T.CorpusSearch(DOCS, k=3).tool.version != corpus.tool.version
    base = corpus.retriever
    for mode, found in (("none", "ab"), ("oracle", "ca"), ("removed", "ab")):
        tool = T.gold_search_tool(base, {"i": ["c"]}, DOCS, mode, 2)
        shown = tool({"query": "red fox"}, T.Context("i"))
        assert [x[1] for x in shown.split("\n\n")] == list(found) and tool.name == corpus.tool.name and tool.description == corpus.tool.description
    with pytest.raises(ValueError, match="no gold"):
        tool({"query": "red"}, T.Context("j"))
    with pytest.raises(ValueError, match="mode"):
        T.gold_search_tool(base, {}, DOCS, "odd")
    with pytest.raises(ValueError, match="fit"):
        T.controlled(base.scores("red"), ["a", "b"], "oracle", 1)
    with pytest.raises(ValueError, match="not there"):
        T.controlled(base.scores("red"), ["z"], "none", 1)


def test_a_retriever_answers():
    class Drawn:
        uses_repeat = True

        def identity(self):
            return {"retriever": "drawn"}

        def retrieve(self, queries, k, repeat=0):
            return [[(f"{q}-{repeat}", 1.0)] for q in queries]

    back = T.RetrieverBackend(Drawn(), 1)
    said = back.complete([{"prompt": "x", "repeat": 1}, {"messages": [{"role": "user", "content": "y"}, {"role": "assistant", "content": "z"}]}, {"messages": [{"role": "assistant", "content": "z"}]}])
    assert [a.get("text") for a in said] == ["x-1", "y-0", None] and "error" in said[2] and said[0]["retrieved"] == ["x-1"]
    tool = T.search_tool(Drawn(), {"q-2": "text"}, 1)
    steps = X.Function(lambda r: {"text": "end"} if "text" in r["prompt"] else {"text": "", "tool_calls": [{"name": "search", "arguments": {"query": "q"}}]})
    assert X.Agent(steps, {"search": tool}).complete([{"prompt": "go", "repeat": 2}])[0]["text"] == "end"
    assert X.Agent(steps, {"search": tool}).identity != X.Agent(steps, {"search": T.Tool("search", tool.run, version="2")}).identity


def test_arrays_beside_rows(spark, tmp_path):
    meta = {"a": np.arange(6, dtype=np.float32).reshape(2, 3), "n": np.int64(3), "deep": {"x": [np.float64(0.5), np.array([1, 2])]}, "t": "s"}
    plain, arrays = A.split_arrays(meta)
    assert plain == {"n": 3, "deep": {"x": [0.5, [1, 2]]}, "t": "s"} and list(arrays) == ["a"]
    store = A.ArrayStore(spark, f"file://{tmp_path}/arrays")
    for _ in range(2):
        store.put(A.array_rows("k1", arrays))
    store.put(A.array_rows("k2", {"b": np.array([[True]])}))
    back = A.load_arrays(store, "k1")
    assert list(back) == ["a"] and back["a"].dtype == np.float32 and (back["a"] == meta["a"]).all()
    assert A.load_arrays(store, "k2")["b"].tolist() == [[True]]
    with pytest.raises(FileNotFoundError):
        A.load_arrays(store, "k3")


def test_shards_of_array_jobs():
    env = {"SLURM_ARRAY_TASK_ID": "7", "SLURM_ARRAY_TASK_MIN": "4", "SLURM_ARRAY_TASK_COUNT": "5"}
    assert I.shard_from_env(env) == (3, 5)
    for bad in ({}, env | {"SLURM_ARRAY_TASK_STEP": "2"}):
        with pytest.raises(RuntimeError):
            I.shard_from_env(bad)
    with pytest.raises(ValueError):
        I.shard_from_env(env | {"SLURM_ARRAY_TASK_ID": "9"})
    assert I.shard_from_k8s(3, {"JOB_COMPLETION_INDEX": "2"}) == (2, 3)
    for bad in ({}, {"JOB_COMPLETION_INDEX": "-1"}):
        with pytest.raises(RuntimeError):
            I.shard_from_k8s(3, bad)
    with pytest.raises(ValueError):
        I.shard_from_k8s(2, {"JOB_COMPLETION_INDEX": "2"})


SINK = "unit_id string, seq bigint, status string, error string"


def test_a_merge_is_not_overwritten_unless_it_is_one(spark, tmp_path, capsys):
    path = f"file://{tmp_path}/rows.jsonl"
    rows = lambda *units: spark.createDataFrame([(u, i, "ok", None) for i, u in enumerate(units)], SINK)
    with pytest.raises(FileNotFoundError):
        J.combine_shards(spark, path, 2, SINK)
    J.append_jsonl(rows("a", "b"), J.shard_path(path, 0, 3))
    J.append_jsonl(rows("c"), J.shard_path(path, 2, 3))
    for _ in range(2):
        cli.main(["merge", path, "3", SINK])
    assert path in capsys.readouterr().out
    assert {r.unit_id for r in J.to_frame(J.read_jsonl(spark, path, SINK)).collect()} == {"a", "b", "c"}
    J.append_jsonl(rows("d"), path)
    with pytest.raises(FileExistsError, match="changed"):
        J.combine_shards(spark, path, 3, SINK)
    J.append_jsonl(rows("x"), f"file://{tmp_path}/own.jsonl")
    with pytest.raises(FileExistsError, match="not made by a merge"):
        J.combine_shards(spark, f"file://{tmp_path}/own.jsonl", 3, SINK)
    J.append_jsonl(rows("a"), J.shard_path(path, 1, 3))
    with pytest.raises(ValueError, match="two shards"):
        J.merge_shards([J.to_frame(J.read_jsonl(spark, J.shard_path(path, i, 3), SINK)) for i in range(3)])


def test_retries_are_in_the_log(spark, tmp_path):
    class Busy:
        identity = "busy"

        def complete(self, requests):
            from plumbline.plans.execution import Transient

            if not getattr(self, "met", False):
                self.met = True
                raise Transient("HTTP 429 too many", 0.01)
            return [{"text": "t"} for _ in requests]

    plan = spark.createDataFrame([(f"u{i}", "i", "c", 0, "p") for i in range(4)], "unit_id string, item_id string, cluster string, repeat int, prompt string").coalesce(1)
    run = X.Run(f"file://{tmp_path}/run")
    X.execute(plan, Busy(), F.lit(1.0), run, batch_size=2)
    log = run.table(spark, "events")
    assert {r.event: r.n for r in log.groupBy("event").agg(F.count("*").alias("n")).collect()} == {"run_start": 1, "run_end": 1, "retry": 1, "unit": 4}
    r = log.where("event = 'retry'").first()
    assert (r.reason, r.wait_s, r.server_wait_s) == ("HTTP 429 too many", 0.01, 0.01)
    assert log.where("event = 'run_start'").first().to_go == 4 and log.where("event = 'run_end'").first().units_done == 4
    assert "retry_reasons" not in run.table(spark, "rows").columns


def test_a_runner_that_fails_leaves_no_end(spark, tmp_path):
    run = X.Run(f"file://{tmp_path}/run")
    with pytest.raises(KeyError), X.Runner(X.Echo(), F.lit(1.0), run):
        raise KeyError("stop")
    assert [r.event for r in run.table(spark, "events").collect()] == ["run_start"]


def test_plugins_and_reports(spark, tmp_path):
    (tmp_path / "mine.py").write_text("from plumbline.plans.experiment import register\nfrom plumbline.plans.execution import Function\n\n@register('backend', 'shout_%s', replace=True)\ndef shout():\n    return Function(lambda r: r['prompt'].upper())\n" % tmp_path.name)
    config = {"task": {"name": "arithmetic", "n_items": 3}, "backend": f"shout_{tmp_path.name}", "axes": {"m": ["x"]}, "out": f"file://{tmp_path}/o", "plugins": ["mine.py"]}
    (tmp_path / "c.json").write_text(json.dumps(config))
    out = E.from_config(spark, str(tmp_path / "c.json")).run()
    assert all(r.text == r.text.upper() for r in out["rows"].collect())
    facts = json.loads((tmp_path / "o" / "run.json").read_text())
    assert facts["source"] == E.source_digest() and facts["versions"]["pyspark"] and json.loads((tmp_path / "o" / "config.json").read_text()) == config
    table = spark.read.option("header", True).csv(f"file://{tmp_path}/o/analysis/attrition.csv")
    assert table.count() == 1 and table.first().n_planned == "3"
    with pytest.raises(E.ConfigError, match="plug-in"):
        E.load_plugins(["absent.py"], str(tmp_path))


def test_verdict_tool():
    tool = V.verdict_tool({"right": "Is it right?", "short": "Is it short?"})
    assert tool["parameters"]["required"] == ["right", "short"] and tool["parameters"]["properties"]["right"] == {"type": "boolean", "description": "Is it right?"}
    for bad in ({}, {"Right": "?"}, {"a b": "?"}):
        with pytest.raises(ValueError):
            V.verdict_tool(bad)


def test_gold_is_refused_where_it_is_missing_or_twice(spark):
    items = spark.createDataFrame([("i", ["a", "a", "b"]), ("j", ["c"])], "item_id string, gold_docs array<string>")
    assert sorted(map(tuple, Q.gold_by_item(items).collect())) == [("i", "a"), ("i", "b"), ("j", "c")]
    with pytest.raises(Exception, match="there twice"):
        Q.gold_by_item(items.union(items)).collect()
    with pytest.raises(Exception, match="no gold"):
        Q.gold_of(spark.createDataFrame([("k",)], "item_id string"), Q.gold_by_item(items), "item_id").collect()


def test_an_index_is_probed_until_it_finds(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, vector array<float>")
    queries = docs.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query"), "vector")
    c, exact = Q.ivf_fit(docs, 24), Q.dense_search(docs, queries, 10)
    n = Q.choose_nprobe(docs, c, 10)
    good = Q.check_recall(Q.ivf_search(Q.ivf_index(docs, c), c, queries, 10, n), exact, 10).first()
    poor = Q.check_recall(Q.ivf_search(Q.ivf_index(docs, c), c, queries, 10, 1), exact, 10).first()
    assert 1 < n <= 24 and good.n_queries == 30 and good.reached and good.warning is None
    assert not poor.reached and "probe more" in poor.warning


def curve(spark, n=60, points=4):
    rng = np.random.default_rng(5)
    rows = [(f"i{i}", x, float(i % 12), float(np.clip(x / points + rng.normal(0, 0.2), 0, 1)), [int(rng.random() < 0.8) for _ in range(1 + i % 3)]) for i in range(n) for x in range(1, points + 1)]
    return spark.createDataFrame(rows, "item_id string, x int, cluster double, v double, ok array<int>")


@pytest.mark.parametrize("kind", ["value", "axis"])
def test_hashed_draws_have_the_points_and_nearly_the_bounds_of_drawn_ones(spark, kind):
    df = curve(spark)
    make = (lambda e: C.value_curves(df, "x", "v", levels=[0.5, 7.0], n_boot=800, engine=e)) if kind == "value" else (lambda e: C.axis_curves(df, "x", "ok", n_boot=800, engine=e))
    key = lambda r: (r.quantity, r.x)
    a, b = ({key(r): r for r in make(e).collect()} for e in ("exact", "poisson"))
    assert set(a) == set(b)
    for k, r in a.items():
        assert (r.point is None) == (b[k].point is None)
        if r.point is not None:
            assert b[k].point == pytest.approx(r.point, abs=1e-9)
            if not k[0].startswith("peak"):
                assert abs(b[k].lo - r.lo) < 0.35 * (r.hi - r.lo) + 1e-9 and abs(b[k].hi - r.hi) < 0.35 * (r.hi - r.lo) + 1e-9
    if kind == "value":
        assert b["crossing_7", None].censored == 1 and b["crossing_7", None].lo is None


def test_hashed_paired_draws(spark):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, c, float(rng.normal(0.3 * (c == "a"))), "g") for i in range(150) for c in "ab"], "cluster bigint, cond string, y double, g string")
    for by in ([], ["g"]):
        a, b = (S.paired_bootstrap(df, "y", "cond", "a", "b", by, n_boot=1500, method="percentile", engine=e).first() for e in ("exact", "poisson"))
        assert b.point == pytest.approx(a.point) and (b.n_clusters, b.n_rows, b.n_unpaired) == (150, 300, 0)
        assert abs(b.se / a.se - 1) < 0.1 and abs(b.lo - a.lo) < 0.4 * a.se and abs(b.hi - a.hi) < 0.4 * a.se
    with pytest.raises(Exception, match="two clusters"):
        S.paired_bootstrap(df.where("cluster = 1"), "y", "cond", "a", "b", engine="poisson").collect()


def test_statements_draw_the_same_weights(spark):
    import duckdb

    keys = [0, 1, 7, 104_993, 2**31, 2**62 + 5]
    rows = spark.createDataFrame([(k,) for k in keys], "k bigint").select("k", F.xxhash64("k").alias("h")).orderBy("k").collect()
    want = S.poisson_weights(np.array([r.h for r in rows], np.int64).view(np.uint64), np.arange(40, dtype=np.uint64), 11)
    found = duckdb.sql(f"SELECT k, b, w FROM {H.poisson_weights('(SELECT unnest(' + str(keys) + ')::BIGINT AS k)', 'k', 40, 11)} ORDER BY b, k").fetchall()
    assert [w for _, _, w in found] == want.ravel().astype(int).tolist()


def test_a_backend_behind_http():
    import http.server
    import threading

    from plumbline.plans import http as W

    seen = []

    class Server(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((body, self.headers.get("Authorization")))
            said = body["messages"][-1]["content"]
            code = {"busy": 429, "bad": 400}.get(said, 200) if len(seen) < 9 else 200
            reply = json.dumps({"choices": [{"message": {"content": said.upper()}, "finish_reason": "length"}], "usage": {"prompt_tokens": 3, "completion_tokens": 1}} if code == 200 else {"error": "no"}).encode()
            self.send_response(code)
            self.send_header("x-ratelimit-limit-requests", "60")
            if code == 429:
                self.send_header("retry-after", "2")
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *_):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        back = W.HTTPBackend(f"http://127.0.0.1:{server.server_port}/v1/chat/completions", "m", ("temperature",), timeout=10.0)
        assert back.complete([{"prompt": "hi", "temperature": 0.5}]) == [{"text": "HI", "truncated": True, "in_tokens": 3, "out_tokens": 1, "logprobs": None}]
        assert seen[0] == ({"model": "m", "messages": [{"role": "user", "content": "hi"}], "temperature": 0.5}, None) and back.limits == {"requests": 60.0}
        with pytest.raises(X.Transient) as busy:
            back.complete([{"prompt": "busy"}])
        assert busy.value.wait == 2.0
        assert X.with_retries(lambda: back.complete([{"prompt": "bad"}]), 1)[0]["error"].startswith("Fatal: HTTP 400")
    finally:
        server.shutdown()
        server.server_close()
    assert X.with_retries(lambda: back.complete([{"prompt": "gone"}]), 1, attempts=2, sleep=lambda s: None)[0]["error"].startswith("Transient")
    tool = {"name": "add", "description": "d", "parameters": {}}
    body = W.chat_body("m", [{"role": "assistant", "content": None, "tool_calls": [{"id": "1", "name": "add", "arguments": {"a": 1}}]}, {"role": "tool", "tool_call_id": "1", "content": "1"}], {"max_tokens": 5, "tool_choice": "add", "top_p": None}, [tool], budget="max_completion_tokens")
    assert body["max_completion_tokens"] == 5 and "top_p" not in body and body["messages"][0]["tool_calls"][0]["function"]["arguments"] == '{"a": 1}' and body["tool_choice"]["function"]["name"] == "add"
    with pytest.raises(X.Fatal, match="top_k"):
        W.chat_body("m", [], {"top_k": 3})
    with pytest.raises(X.Fatal, match="no tool"):
        W.chat_body("m", [], {"tool_choice": "x"}, [tool])
    calls = W.parse_chat({"choices": [{"message": {"tool_calls": [{"id": "1", "type": "function", "function": {"name": "add", "arguments": '{"a": 2}'}}]}, "finish_reason": "tool_calls"}]})
    assert calls["tool_calls"] == [{"id": "1", "name": "add", "arguments": {"a": 2}}] and not calls["truncated"]
    with pytest.raises(X.Fatal):
        W.parse_chat({})
