"""Queries about runs and what they write: sinks, plans, calls, logs, tools; each beside its statement."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog import COSINE, CURVE, LABEL_STATUS, asked, draws_of, islands, label_rows, line_values, query, rounded, table, vectors
from plumbline.functions import text as X
from plumbline.operators import contamination as N
from plumbline.operators import curves as C
from plumbline.operators import events as E
from plumbline.operators import judges as V
from plumbline.operators import retrieval as Q
from plumbline.operators import statistics as S
from plumbline.plans import execution, grid, search_tools
from plumbline.plans.identity import shard_of
from plumbline.sources import jsonl, tasks
from plumbline.sources.tables import shared_folder
from plumbline.streaming import live


def fresh(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# == sinks ==

SINK = "unit_id string, seq bigint, status string, error string, value double"


def sink_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("CAST(user_id AS STRING) AS unit_id", "event_id AS seq", "CASE WHEN event_id % 9 = 0 THEN 'truncated' END AS status", "CASE WHEN event_type = 'error' THEN props END AS error", "value")


LAST = """SELECT unit_id, seq, CASE WHEN error IS NOT NULL THEN 'error' ELSE coalesce(status, 'ok') END AS status, error, value FROM (SELECT user_id::VARCHAR AS unit_id, event_id AS seq, CASE WHEN event_id % 9 = 0 THEN 'truncated' END AS status,
  CASE WHEN event_type = 'error' THEN props END AS error, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1"""


@query(f"SELECT *, 3 AS n_bad FROM ({LAST})")
def sink_round_trip(spark, sf):
    """Rows appended in two parts as JSON lines, with torn lines between them, read back."""
    path, rows = fresh(spark, "sink"), sink_rows(spark, sf)
    jsonl.append_jsonl(rows.where("seq % 2 = 0"), path)
    spark.createDataFrame([('{"unit_id": "1", "seq": 99',), ("torn",), ("",), ('["x"',)], "value string").write.mode("append").text(path)
    jsonl.append_jsonl(rows.where("seq % 2 = 1"), path)
    lines = jsonl.read_jsonl(spark, path, SINK)
    return jsonl.to_frame(lines).crossJoin(jsonl.count_bad(lines))


@query(f"SELECT unit_id, seq, status, value FROM ({LAST}) WHERE error IS NULL")
def sink_without_errors(spark, sf):
    path = fresh(spark, "sink")
    jsonl.append_jsonl(sink_rows(spark, sf), path)
    return jsonl.to_frame(jsonl.read_jsonl(spark, path, SINK), drop_errors=True).select("unit_id", "seq", "status", "value")


@query("SELECT ts AS t, event_type AS event, user_id FROM events")
def event_log_round_trip(spark, sf):
    path = fresh(spark, "log")
    jsonl.append_jsonl(table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t"), F.col("event_type").alias("event"), "user_id"), path)
    return jsonl.read_events(spark, path, "t string, event string, user_id bigint").select(F.col("t").cast("timestamp_ntz").alias("t"), "event", "user_id")


@query("SELECT c_name AS unit_id, CASE WHEN c_custkey % 3 = 0 THEN 'first' ELSE 'second' END AS content, c_custkey AS plan_seq FROM customer")
def manifest_round_trip(spark, sf):
    """A plan written in two runs: the first record of a unit stays."""
    path, plan = fresh(spark, "plan"), table(spark, sf, "customer").select(F.col("c_name").alias("unit_id"), F.col("c_custkey").alias("plan_seq"))
    schema = "unit_id string, plan_seq bigint, content string"
    for content, part in (("first", plan.where("plan_seq % 3 = 0")), ("second", plan)):
        jsonl.append_plan(part.withColumn("content", F.lit(content)), path, jsonl.read_manifest(spark, path, schema))
    return jsonl.read_manifest(spark, path, schema).select("unit_id", "content", "plan_seq")


def customer_shards(spark: SparkSession, sf: str, n: int) -> tuple[str, str]:
    path, schema = fresh(spark, "run.jsonl"), "unit_id string, seq bigint, status string, error string"
    rows = table(spark, sf, "customer").select(F.col("c_name").alias("unit_id"), F.col("c_custkey").alias("seq"), F.lit("ok").alias("status"))
    for i in range(n):
        jsonl.append_jsonl(rows.where(shard_of(F.col("unit_id"), n) == i), jsonl.shard_path(path, i, n))
        jsonl.append_jsonl(rows.where(shard_of(F.col("unit_id"), n) == i).select("unit_id"), jsonl.companion(jsonl.shard_path(path, i, n), "manifest"))
    return path, schema


@query("""SELECT c_name AS unit_id, c_custkey AS seq, (('0x' || substr(sha256(c_name), 1, 16))::UBIGINT % 4)::INTEGER AS shard FROM customer""")
def merged_shards(spark, sf):
    path, schema = customer_shards(spark, sf, 4)
    return jsonl.merge_shards([jsonl.to_frame(jsonl.read_jsonl(spark, jsonl.shard_path(path, i, 4), schema)) for i in range(4)]).select("unit_id", "seq", "shard")


@query("SELECT c_name AS unit_id, c_custkey AS seq, true AS planned FROM customer")
def combined_shards(spark, sf):
    """Shards written as one sink, twice, and its rows beside its plan."""
    path, schema = customer_shards(spark, sf, 3)
    for _ in range(2):
        jsonl.combine_shards(spark, path, 3, schema)
    plan = jsonl.read_manifest(spark, jsonl.companion(path, "manifest"), "unit_id string", ("unit_id",)).withColumn("planned", F.lit(True))
    return jsonl.to_frame(jsonl.read_jsonl(spark, path, schema)).select("unit_id", "seq").join(plan, "unit_id", "left")


@query("SELECT item_id::VARCHAR AS id, text AS prompt, 'exact' AS grader, upper(text[1:3]) AS gold FROM benchmark")
def tasks_round_trip(spark, sf):
    path = fresh(spark, "tasks") + ".jsonl"
    items = table(spark, sf, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("prompt"), F.lit("exact").alias("grader"), X.upper(F.left("text", F.lit(3))).alias("gold"))
    tasks.save_tasks(items, path)
    return tasks.load_tasks(spark, path).select("id", "prompt", "grader", "gold")


@query("SELECT n_nationkey::VARCHAR AS id, n_name AS prompt, r_name AS \"group\" FROM nation JOIN region ON n_regionkey = r_regionkey")
def tasks_by_mapping(spark, sf):
    """Foreign records in a container of one document, read by dotted paths."""
    path = fresh(spark, "foreign") + ".json"
    own = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    record = F.struct(F.col("n_nationkey").alias("key"), F.struct(F.array("n_name").alias("names")).alias("q"), F.col("r_name").alias("part"))
    own.agg(F.to_json(F.struct(F.collect_list(record).alias("examples"))).alias("value")).write.text(path)
    return tasks.load_tasks(spark, path, {"id": "key", "prompt": "q.names.0", "group": "part"}).select("id", "prompt", "group")


@query("SELECT doc_id::VARCHAR AS doc_id, md5(coalesce(text, '')) AS digest FROM documents")
def corpus_round_trip(spark, sf):
    path = fresh(spark, "corpus") + ".jsonl"
    table(spark, sf, "documents").select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.coalesce("text", F.lit("")).alias("text"))).alias("value")).write.text(path)
    return tasks.load_corpus(spark, path).select("doc_id", F.md5("text").alias("digest"))


@query("""SELECT doc_id AS item_id, f.fault FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'no id' WHEN doc_id % 11 = 0 THEN 'exactly one of prompt and messages is needed' WHEN doc_id % 5 = 0 AND doc_id % 3 <> 0 THEN 'a grader without gold' END AS fault FROM documents) f WHERE f.fault IS NOT NULL""")
def task_faults(spark, sf):
    d = F.col("doc_id")
    items = table(spark, sf, "documents").select(
        F.when(d % 7 != 0, d.cast("string")).alias("id"), F.when(d % 11 != 0, "p").alias("prompt"), F.lit(None).cast("string").alias("messages"), F.when(d % 5 == 0, "exact").alias("grader"),
        F.when(d % 3 == 0, "g").alias("gold"), F.lit(None).cast("string").alias("gold_docs"), d.alias("item_id"),
    )
    own = tasks.faults(items.withColumn("id", F.coalesce("id", F.concat(F.lit("-"), "item_id"))).where("item_id % 7 <> 0"))
    none = items.where("item_id % 7 = 0")
    return own.select(F.col("id").cast("bigint").alias("item_id"), "fault").union(none.select("item_id", F.lit("no id")))


# == plans ==


def plan_of(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "region").select(F.col("r_regionkey").alias("cell_seq"), F.col("r_name").alias("cell_id"))
    items = table(spark, sf, "nation").select(F.col("n_nationkey").alias("item_seq"), F.col("n_name").alias("item_id"))
    return grid.units(cells, items, 2)


UNITS = "SELECT r_name AS cell_id, n_name AS item_id, k::INTEGER AS repeat, (r_regionkey * 25 + n_nationkey) * 2 + k AS plan_seq FROM region, nation, range(2) t(k)"


@query(UNITS)
def plan_units(spark, sf):
    return plan_of(spark, sf).select("cell_id", "item_id", "repeat", "plan_seq")


@query(f"{UNITS} ORDER BY plan_seq LIMIT 33")
def plan_limited(spark, sf):
    return grid.limited(plan_of(spark, sf), 33).select("cell_id", "item_id", "repeat", "plan_seq")


DECIDED = """WITH last AS (SELECT * FROM (SELECT l_orderkey, l_returnflag, l_linestatus, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1),
d AS (SELECT o_orderkey, o_orderpriority, CASE WHEN l.l_orderkey IS NULL THEN 'call' WHEN l_returnflag = 'R' THEN 'retry' WHEN l_linestatus IS DISTINCT FROM o_orderstatus THEN 'stale' WHEN l_linenumber % 2 = 0 THEN 'rescore' ELSE 'done' END AS decision
  FROM orders LEFT JOIN last l ON o_orderkey = l.l_orderkey)"""


def decided(spark: SparkSession, sf: str) -> DataFrame:
    from plumbline.catalog import QUERIES

    return QUERIES["resume_decisions"](spark, sf)


@query(f"""{DECIDED} SELECT count(*) AS n_units, count(*) FILTER (decision IN ('call', 'retry', 'stale')) AS to_go, count(*) FILTER (decision = 'retry') AS retried, count(*) FILTER (decision = 'stale') AS stale,
  count(*) FILTER (decision = 'rescore') AS rescored, count(*) FILTER (decision IN ('done', 'rescore')) AS done FROM d""")
def plan_counts(spark, sf):
    return grid.plan_counts(decided(spark, sf))


@query(f"{DECIDED} SELECT count(*) AS to_call, round(count(*) * 0.0035, 6) AS cost FROM d WHERE decision IN ('call', 'retry', 'stale') AND o_orderkey % 4 <> 0")
def plan_cost(spark, sf):
    """What the open calls cost that a cache of every fourth request does not answer."""
    todo = decided(spark, sf).withColumn("request_key", F.col("unit_id"))
    cache = table(spark, sf, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("request_key"))
    return rounded(grid.cost(todo, cache, 500, 200, {"in": 3.0, "out": 10.0}))


@query("SELECT l_linenumber AS batch_size FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def modal_batch_size(spark, sf):
    return grid.modal_batch_size(table(spark, sf, "lineitem").select(F.col("l_linenumber").alias("batch_size")))


@query("SELECT d.doc_id AS unit_id FROM documents d ANTI JOIN labels l USING (doc_id)")
def never_tried(spark, sf):
    return execution.never_tried(table(spark, sf, "documents").select(F.col("doc_id").alias("unit_id")), table(spark, sf, "labels").select(F.col("doc_id").alias("unit_id")))


@query("SELECT n_name AS item_id, coalesce(nullif(CASE WHEN n_regionkey = 1 THEN '' WHEN n_regionkey = 2 THEN NULL ELSE r_name END, ''), n_name) AS cluster FROM nation JOIN region ON n_regionkey = r_regionkey")
def item_clusters(spark, sf):
    own = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return grid.with_clusters(own.selectExpr("n_name AS item_id", "CASE WHEN n_regionkey = 1 THEN '' WHEN n_regionkey = 2 THEN NULL ELSE r_name END AS parent_id")).select("item_id", "cluster")


# == calls ==


def answer(request: dict) -> str:
    if request["prompt"].startswith("I"):
        raise ValueError(f"no answer for {request['item_id']}")
    return request["prompt"][::-1]


def call_plan(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").selectExpr("concat('u', n_nationkey) AS unit_id", "n_name AS item_id", "CAST(n_regionkey AS STRING) AS cluster", "0 AS repeat", "n_name AS prompt", "reverse(n_name) AS gold")


def right() -> Column:
    return (F.col("text") == F.col("gold")).cast("double")


CALLED = """SELECT 'u' || n_nationkey AS unit_id, CASE WHEN n_name NOT LIKE 'I%' THEN reverse(n_name) END AS text, CASE WHEN n_name LIKE 'I%' THEN 'error' ELSE 'ok' END AS status, CASE WHEN n_name NOT LIKE 'I%' THEN 1.0 END AS correct,
  CASE WHEN n_name LIKE 'I%' THEN 'ValueError: no answer for ' || n_name END AS error FROM nation"""


@query(CALLED)
def executed_units(spark, sf):
    """Answers of a function, asked twice: the second run calls failed units only."""
    run = execution.Run(fresh(spark, "run"))
    for _ in range(2):
        rows = execution.execute(call_plan(spark, sf), execution.Function(answer), right(), run)
    return rows.select("unit_id", "text", "status", "correct", "error")


@query("""SELECT unnest(['run_start', 'run_end', 'unit', 'error']) AS event, unnest([2, 2, (SELECT count(*) + count(*) FILTER (n_name LIKE 'I%') FROM nation), (SELECT 2 * count(*) FILTER (n_name LIKE 'I%') FROM nation)]) AS n""")
def executed_log(spark, sf):
    """What the log of two runs holds; errors are counted apart."""
    run = execution.Run(fresh(spark, "run"))
    for _ in range(2):
        execution.execute(call_plan(spark, sf), execution.Function(answer), right(), run)
    log = run.table(spark, "events")
    kinds = log.groupBy("event").agg(F.count("*").alias("n"))
    return kinds.union(log.where("event = 'unit' AND error IS NOT NULL").agg(F.lit("error"), F.count("*")))


@query(CALLED)
def runner_batches(spark, sf):
    """The same answers where units come in three parts."""
    run, plan = execution.Run(fresh(spark, "run")), call_plan(spark, sf)
    with execution.Runner(execution.Function(answer), right(), run) as runner:
        for i in range(3):
            runner.run_batch(plan.where(F.pmod(F.substring("unit_id", 2, 9).cast("int"), F.lit(3)) == i))
    return execution.latest_rows(run.table(spark, "rows")).select("unit_id", "text", "status", "correct", "error")


@query(f"""WITH docs AS (SELECT item_id AS doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM benchmark), s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM docs),
tf AS (SELECT doc_id, len, term, count(*) AS f FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM docs) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)) AS weight FROM tf JOIN df USING (term), s),
q AS (SELECT query, term, count(*) AS q FROM (SELECT doc_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents WHERE doc_id % 100 = 0) GROUP BY 1, 2),
sc AS (SELECT query, doc_id, round(sum(weight * q), 9) AS score FROM w JOIN q USING (term) GROUP BY 1, 2), r AS (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id::VARCHAR) AS pos FROM sc WHERE score > 0)
SELECT d.doc_id::VARCHAR AS unit_id, coalesce(string_agg(r.doc_id::VARCHAR, chr(10) ORDER BY pos), '') AS text FROM (SELECT doc_id FROM documents WHERE doc_id % 100 = 0) d LEFT JOIN r ON d.doc_id = r.query AND pos <= 5 GROUP BY 1""")
def retriever_backend(spark, sf):
    """Benchmark items as the corpus of a tool in memory, searched for every hundredth document."""
    corpus = {str(r["item_id"]): r["text"] or "" for r in table(spark, sf, "benchmark").collect()}
    units = table(spark, sf, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").cast("string").alias("unit_id"), F.lit(0).alias("repeat"), F.coalesce("text", F.lit("")).alias("prompt"))
    return execution.call_backend(units, search_tools.RetrieverBackend(search_tools.Lexical(corpus), 5)).select("unit_id", "text")


class Judge:
    """Says yes to texts of at least so many characters, and nothing sound where the key is divisible by 7."""

    def __init__(self, least: int) -> None:
        self.identity = self.least = least

    def complete(self, requests: list[dict]) -> list[dict]:
        out = []
        for r in requests:
            call = [{"name": "verdict", "arguments": json.dumps({"long": len(r["prompt"]) >= self.least})}]
            out.append({"text": "yes" if int(r["answer"]) % 7 == 0 else json.dumps(call)})
        return out


@query("""SELECT n_nationkey AS answer, r_name AS cluster, j.judge, 'long' AS criterion, CASE WHEN n_nationkey % 7 = 0 THEN 'unparsed' ELSE 'ok' END AS status, CASE WHEN n_nationkey % 7 <> 0 THEN (length(n_name) >= j.least)::INT::DOUBLE END AS verdict
FROM nation JOIN region ON n_regionkey = r_regionkey, (VALUES ('lax', 6), ('strict', 9)) j(judge, least)""")
def judge_panel(spark, sf):
    own = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    answers = own.selectExpr("n_nationkey AS answer", "r_name AS cluster", "n_name AS prompt")
    return V.run_panel(answers, {"lax": Judge(6), "strict": Judge(9)}, {"long": "Is it long?"}).select("answer", "cluster", "judge", "criterion", "status", "verdict")


@query(f"""SELECT d.doc_id AS item_id, d.source AS cluster, md5('Grade the answer by each criterion.' || chr(10) || chr(10) || 'Is it good?' || chr(10) || chr(10) || 'Task: ' || d.lang || chr(10) || chr(10) || 'Answer: ' || d.text) AS prompt
FROM labels l JOIN documents d USING (doc_id) WHERE {LABEL_STATUS} IN ('ok', 'unparsed') AND trim(d.text) <> ''""")
def judge_prompts(spark, sf):
    rows = label_rows(spark, sf).select(F.col("unit_id").alias("doc_id"), "status").join(table(spark, sf, "documents"), "doc_id").where("trim(text) <> ''")
    return V.judge_prompts(rows.selectExpr("doc_id AS item_id", "source AS cluster", "lang AS prompt", "text", "status"), "Is it good?").select("item_id", "cluster", F.md5("prompt").alias("prompt"))


@query("""WITH g AS (SELECT c_custkey AS answer, c_custkey * 37 AS gold, (c_custkey * 37)::VARCHAR AS s FROM customer),
w AS (SELECT answer, s, (SELECT min(i) FROM range(1, length(s)) t(i) WHERE s[i] <> s[i + 1] AND (i > 1 OR s[i + 1] <> '0')) AS i FROM g)
SELECT answer, 'plain' AS variant, s AS text, 1.0 AS reference FROM g UNION ALL SELECT answer, 'separated', format('{:,}', gold), 1.0 FROM g UNION ALL SELECT answer, 'off_by_one', (gold + 1)::VARCHAR, 0.0 FROM g
UNION ALL SELECT answer, 'swapped', s[1:i - 1] || s[i + 1] || s[i] || s[i + 2:], 0.0 FROM w WHERE i IS NOT NULL""")
def calibration_items(spark, sf):
    return V.calibration_items(table(spark, sf, "customer").selectExpr("c_custkey AS answer", "c_custkey * 37 AS gold"))


# == logs ==


def run_log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("ts AS t", "CASE event_type WHEN 'signup' THEN 'run_start' WHEN 'purchase' THEN 'run_end' WHEN 'error' THEN 'retry' ELSE 'unit' END AS event", "event_id AS n_units", "event_id % 10 AS to_go",
        "concat('HTTP ', event_id % 8 + 500, ' by host ', chr(97 + event_id % 7)) AS reason", "value AS wait_s", "CASE WHEN event_id % 2 = 0 THEN value END AS server_wait_s", "CASE WHEN event_id % 3 = 0 THEN CAST('NaN' AS DOUBLE) WHEN event_id % 3 = 1 THEN value END AS in_tokens", "CAST(user_id AS DOUBLE) AS out_tokens", "value AS latency_s", "user_id")


@query("""WITH e AS (SELECT *, count(*) FILTER (event_type = 'signup') OVER (ORDER BY ts) AS run FROM events), r AS (SELECT run, min(ts) FILTER (event_type = 'signup') AS started, min(ts) FILTER (event_type = 'purchase') AS ended_at,
  max(ts) FILTER (event_type NOT IN ('signup', 'purchase', 'error')) AS unit, count(*) FILTER (event_type NOT IN ('signup', 'purchase', 'error')) AS units_done, first(event_id ORDER BY ts) FILTER (event_type = 'signup') AS planned FROM e WHERE run > 0 GROUP BY 1)
SELECT run, started, ended_at IS NOT NULL AS ended, coalesce(ended_at, unit, started) AS last_event, round((epoch_us(coalesce(ended_at, unit, started)) - epoch_us(started)) / 1e6, 6) AS elapsed_s, planned, planned % 10 AS to_go, units_done FROM r""")
def runs(spark, sf):
    return rounded(E.runs(run_log(spark, sf)))


@query("""SELECT round(sum(CASE WHEN event_id % 3 = 1 THEN value ELSE 0 END), 4) AS in_tokens, sum(user_id)::DOUBLE AS out_tokens, round((sum(CASE WHEN event_id % 3 = 1 THEN value ELSE 0 END) * 2.5 + sum(user_id) * 10) / 1e6, 4) AS cost
FROM events WHERE event_type NOT IN ('signup', 'purchase', 'error')""")
def token_cost(spark, sf):
    return rounded(E.tokens(run_log(spark, sf), {"in": 2.5, "out": 10.0}), 4)


@query("SELECT quantile_cont(n, 0.5)::DOUBLE AS median, min(n) AS min, max(n) AS max FROM (SELECT date_trunc('minute', ts) AS m, count(*) AS n FROM events WHERE event_type NOT IN ('signup', 'purchase', 'error') GROUP BY 1)")
def throughput(spark, sf):
    return E.throughput(run_log(spark, sf))


@query("""SELECT 'HTTP # by host ' || chr((97 + event_id % 7)::INT) AS kind, count(*) AS n, round(sum(value), 4) AS wait_s, count(*) FILTER (event_id % 2 = 0 AND value IS NOT NULL) AS server_requested FROM events WHERE event_type = 'error' GROUP BY 1 ORDER BY n DESC, kind LIMIT 5""")
def retry_reasons(spark, sf):
    return rounded(E.retries(run_log(spark, sf)), 4)


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) < 21600000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_sessions(spark, sf):
    stream = live.file_stream(spark, f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("t"), "user_id")
    out = live.drain(live.sessions(stream, "6 hours", by="user_id"), "sessions")
    return out.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "n")


@query("""WITH r AS (SELECT user_id % 7919 AS run_id, count(*) FILTER (event_type NOT IN ('signup', 'purchase')) AS units, bool_or(event_type = 'purchase' AND user_id % 2 = 0) AS ended, min(ts) AS started, max(ts) AS last_event FROM events GROUP BY 1)
SELECT run_id, CASE WHEN ended THEN 'ended' ELSE 'killed' END AS outcome, started, last_event, units FROM r WHERE ended OR last_event + INTERVAL 20 MINUTE < (SELECT max(ts) FROM events)""")
def stream_run_ends(spark, sf):
    """Runs, one per user, that ended or fell silent for ten minutes before the watermark."""
    kind = F.expr("CASE WHEN event_type = 'purchase' AND user_id % 2 = 0 THEN 'run_end' WHEN event_type IN ('signup', 'purchase') THEN 'other' ELSE 'unit' END")
    stream = live.file_stream(spark, f"{sf}/events.parquet").select(F.expr("user_id % 7919").alias("run_id"), F.col("ts").cast("timestamp").alias("t"), kind.alias("event"))
    out = live.drain(live.run_ends(stream), "run_ends", "append")
    return out.select("run_id", "outcome", F.col("started").cast("timestamp_ntz").alias("started"), F.col("last_event").cast("timestamp_ntz").alias("last_event"), "units")


# == text, caveats, curves, gold ==


@query("""SELECT c_custkey, format('{:,}', c_custkey * 12345) AS thousands, levenshtein(c_name, c_mktsegment) AS edits, round((instr(c_name, '0') - 1) / greatest(1, length(c_name) - 1), 6) AS place, CASE WHEN c_custkey % 3 = 0 THEN c_custkey::DOUBLE END AS typed,
  c_name || chr(10) || chr(10) || c_mktsegment AS prompt FROM customer""")
def text_functions(spark, sf):
    c = F.col
    out = table(spark, sf, "customer").select(
        "c_custkey", X.thousands(c("c_custkey") * 12345).alias("thousands"), X.edit_distance(c("c_name"), c("c_mktsegment")).alias("edits"), X.relative_position(c("c_name"), F.lit("0")).alias("place"),
        jsonl.typed(F.when(c("c_custkey") % 3 == 0, c("c_custkey").cast("string")).otherwise("none")).alias("typed"), X.prompt(c("c_name"), F.lit(None).cast("string"), c("c_mktsegment")).alias("prompt"),
    )
    return rounded(out)


_NEAR = "CASE WHEN k >= 30 THEN 30 WHEN k >= 20 THEN 20 WHEN k >= 10 THEN 10 WHEN k >= 5 THEN 5 ELSE 3 END"


@query(f"""WITH x AS (SELECT n_nationkey AS k, n_regionkey::DOUBLE AS se, 10 AS n_rows, n_regionkey AS n_excluded FROM nation), t AS (SELECT k, CASE WHEN k > 0 AND k < 20 THEN 'only ' || k || ' clusters: the interval is too narrow (a nominal 95% interval covers ~' ||
  CASE {_NEAR} WHEN 3 THEN 73 WHEN 5 THEN 84 WHEN 10 THEN 90 WHEN 20 THEN 92 ELSE 94 END || '% at k=' || {_NEAR} || ')' END AS a, CASE WHEN se = 0 THEN 'no spread in the values: a zero-width interval, not certainty' END AS b,
  CASE WHEN n_excluded / (n_rows + n_excluded) > 0.1 THEN round_even(100 * n_excluded / (n_rows + n_excluded), 0)::INT || '% of rows have no value: the estimate describes the survivors (see attrition)' END AS c FROM x)
SELECT k, concat_ws('; ', a, b, c) AS caveats FROM t""")
def caveats(spark, sf):
    x = table(spark, sf, "nation").selectExpr("n_nationkey AS k", "CAST(n_regionkey AS DOUBLE) AS se", "10 AS n_rows", "n_regionkey AS n_excluded")
    return x.select("k", S.cell_caveats(*[F.col(c) for c in x.columns]).alias("caveats"))


@query("""WITH x AS (SELECT DISTINCT l_returnflag AS f, l_suppkey AS item, l_linenumber AS x FROM lineitem WHERE l_quantity > 48), nx AS (SELECT f, count(DISTINCT x) AS n FROM x GROUP BY 1), i AS (SELECT f, item, count(*) AS n FROM x GROUP BY 1, 2)
SELECT f AS l_returnflag, count(*) FILTER (i.n = nx.n) AS n_items, count(*) FILTER (i.n < nx.n) AS n_dropped FROM i JOIN nx USING (f) GROUP BY 1""")
def dropped_items(spark, sf):
    rows = table(spark, sf, "lineitem").where("l_quantity > 48").groupBy("l_returnflag", F.col("l_suppkey").alias("item_id"), F.col("l_linenumber").alias("x")).agg(F.avg("l_quantity").alias("v"))
    return C.n_dropped(rows, "x", F.col("v").isNotNull(), ["l_returnflag"])


@query(f"""{CURVE.partition(", m AS (SELECT x::DOUBLE")[0]}, rows_ AS (SELECT * FROM x SEMI JOIN whole USING (item)), keys AS (SELECT DISTINCT item FROM rows_), w AS {draws_of("keys", "item")},
m AS (SELECT b, x::DOUBLE AS x, sum(w * v) / nullif(sum(w), 0) AS mean FROM rows_ JOIN w USING (item) GROUP BY 1, 2), s AS (SELECT b, max(mean) - min(mean) AS v FROM m GROUP BY 1)
SELECT 'spread' AS quantity, NULL::DOUBLE AS x, round(max(v) FILTER (b < 0), 5) AS point, round(quantile_cont(v, 0.025) FILTER (b >= 0), 5) AS lo, round(quantile_cont(v, 0.975) FILTER (b >= 0), 5) AS hi, 0.0 AS censored FROM s""")
def axis_statistic(spark, sf):
    """Any statistic of a curve's replicates: here how far its points spread."""
    return rounded(C.axis_bootstrap(line_values(spark, sf), "x", "v", lambda x, m: {"spread": m.max(axis=1) - m.min(axis=1)}, n_boot=200), 5)


GOLD = "list_distinct([item_id % 5, item_id % 3])"


@query(f"SELECT item_id, unnest({GOLD}) AS doc_id FROM benchmark")
def gold_of_items(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", F.array(F.col("item_id") % 5, F.col("item_id") % 3).alias("gold_docs"))
    return Q.gold_of(items, Q.gold_by_item(items), "item_id")


@query(f"SELECT DISTINCT text AS query, unnest({GOLD}) AS doc_id FROM benchmark QUALIFY count(*) OVER (PARTITION BY text) > 0")
def gold_of_queries(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("text").alias("query"), F.array(F.col("item_id") % 5, F.col("item_id") % 3).alias("gold_docs"))
    return Q.gold_of(asked(spark, sf).select(F.col("text").alias("query")), Q.gold_by_query(items))


@query(f"""{COSINE}, k AS (SELECT query, doc_id, pos FROM ranked WHERE pos <= 5), g AS (SELECT query, query AS doc_id FROM q)
SELECT k.query, 5 AS depth, 1.0 AS "recall@5", 1.0 AS "hit@5", round(1 / log2(max(pos) FILTER (k.doc_id = k.query) + 1), 6) AS "ndcg@5", round(1 / max(pos) FILTER (k.doc_id = k.query), 6) AS rr FROM k GROUP BY 1""")
def score_ranked(spark, sf):
    """Each vector should find itself."""
    docs, queries = vectors(spark, sf)
    return rounded(Q.score_ranked(Q.dense_search(docs, queries, 5), queries.select("query", F.col("query").alias("doc_id")), (5,))).withColumn("depth", F.col("depth").cast("int"))


@query(f"{COSINE} SELECT query, pos, doc_id, (row_number() OVER (PARTITION BY query ORDER BY doc_id) - 1)::INT AS rank FROM ranked WHERE pos <= 5")
def inverse_rank(spark, sf):
    return Q.inverse_rank(Q.dense_search(*vectors(spark, sf), 5)).select("query", "pos", "doc_id", "rank")


@query("""WITH c AS (SELECT n_name AS name, n_name AS s FROM nation), r AS (SELECT r_name AS name, r_name AS s FROM region), cw AS (SELECT name, string_split(s, '') AS w FROM c), rw AS (SELECT name, string_split(s, '') AS w FROM r)
SELECT c.name, coalesce(longest, 0)::INT AS longest_match, coalesce(longest, 0) >= 64 AS capped FROM c LEFT JOIN """ + islands("cw", "rw") + " m USING (name)")
def longest_match_of_names(spark, sf):
    """Shared runs of characters."""
    names = lambda t, c: table(spark, sf, t).select(F.col(c).alias("name"), F.col(c).alias("seq"))
    return N.longest_match(names("nation", "n_name"), names("region", "r_name"))
