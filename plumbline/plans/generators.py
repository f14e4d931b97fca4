"""Deterministic task items: sums, execution traces and a small world of towns.

Each item's draws come from a generator of its own or from one sequential stream per seed; golds are
queries over the generated tables, so they are exact by construction.
"""

from __future__ import annotations

import json
import random
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ITEM = "id string, prompt string, gold string, grader string, target string, gold_docs array<string>, cluster string, `group` string, meta string"


# == sums ==


def _triple(rng: random.Random, low: int, high: int, op: str) -> tuple[int, int, int]:
    a, b = rng.randint(low, high), rng.randint(low, high)
    if op == "-":
        a, b = max(a, b), min(a, b)
    return a, b, a + b if op == "+" else a - b if op == "-" else a * b


def sums(op: str = "+", digits: int = 2, seed: int = 0, n_items: int = 1024, n_shots: int = 4, exclude_leaks: bool = True, spaced: bool = False) -> Iterator[dict]:
    """Few-shot sums; questions differ while there are enough, and no shot shows the answer unless allowed."""
    if op not in "+-*" or len(op) != 1:
        raise ValueError(f"op is +, - or *, not {op!r}")
    low, high = (10 ** (digits - 1) if digits > 1 else 0), 10**digits - 1
    shown = lambda n: " ".join(str(n)) if spaced else str(n)
    rng, seen, made = random.Random(seed), set(), 0
    while made < n_items:
        shots = [_triple(rng, low, high, op) for _ in range(n_shots)]
        a, b, c = _triple(rng, low, high, op)
        if (a, b) in seen and len(seen) < (high - low + 1) ** 2:
            continue
        seen.add((a, b))
        gives_away = lambda s: s[2] == c or s[:2] == (a, b)  # noqa: B023, E731
        for k in range(n_shots if exclude_leaks else 0):
            while gives_away(shots[k]):
                shots[k] = _triple(rng, low, high, op)
        prompt = "".join(f"{x} {op} {y} = {shown(z)}\n" for x, y, z in shots) + f"{a} {op} {b} ="
        meta = dict(a=a, b=b, answer=c, op=op, leak=any(map(gives_away, shots)), digits=digits, n_shots=n_shots, spaced=spaced)
        yield {"id": f"{op}d{digits}s{n_shots}-{seed}-{made:05d}", "prompt": prompt, "gold": shown(c), "grader": "exact", "target": f" {shown(c)}", "meta": meta}
        made += 1


def sum_items(spark: SparkSession, **kw) -> DataFrame:
    rows = [(i["id"], i["prompt"], i["gold"], i["grader"], i["target"], None, None, None, json.dumps(i["meta"])) for i in sums(**kw)]
    return spark.createDataFrame(rows, ITEM)


def leak_rate(items: DataFrame) -> DataFrame:
    """One row: the share of items whose shots show the answer."""
    return items.agg(F.avg((F.get_json_object("meta", "$.leak") == "true").cast("double")).alias("leak_rate"))


# == traces ==

OPERATIONS = ("fetch_page", "parse_html", "load_table", "train_step", "write_file", "send_mail", "compress", "index_rows")
LENGTH = (2.9, 1.1)
ATTRIBUTES = ("rows", "bytes", "retries_left", "shard")
SPAN = "trace string, id string, name string, parent string, start_ms int, end_ms int, status string, attempt int, attrs map<string,int>"


def _trace(name: str, seed: str, n_spans: int, depth: int, p_error: float, p_retry: float) -> list[tuple]:
    """Spans of one trace as rows of ``SPAN``; children run one after the other inside their parent."""
    rng, spans = random.Random(seed), []

    def grow(op: str, parent: str | None, start: int, level: int, attempt: int = 1) -> dict:
        span = {"id": f"s{len(spans):03d}", "name": op, "parent": parent, "start": start, "status": "ok", "attempt": attempt}
        spans.append(span)
        clock, children = start + rng.randint(1, 5), 0
        for _ in range(rng.randint(1, 5) if level == 0 else rng.choice((0, 0, 1, 2)) if level < depth else 0):
            if len(spans) >= n_spans:
                break
            children += 1
            child = grow(rng.choice(OPERATIONS), span["id"], clock, level + 1)
            clock = child["end"] + rng.randint(1, 5)
            if child["status"] == "error" and len(spans) < n_spans and rng.random() < p_retry:
                clock = grow(child["name"], span["id"], clock, level + 1, child["attempt"] + 1)["end"] + rng.randint(1, 5)
        if not children:
            clock += 1 + int(rng.lognormvariate(*LENGTH))
            if level and rng.random() < p_error:
                span["status"] = "error"
        span["end"] = clock
        span["attrs"] = {a: rng.randint(1, 5000) for a in rng.sample(ATTRIBUTES, rng.randint(0, 2))}
        return span

    root = grow("job", None, 0, 0)
    while len(spans) < n_spans:
        root["end"] = grow(rng.choice(OPERATIONS), root["id"], root["end"] + 1, 1)["end"] + rng.randint(1, 5)
    return [(name, s["id"], s["name"], s["parent"], s["start"], s["end"], s["status"], s["attempt"], s["attrs"]) for s in spans]


def traces(spark: SparkSession, n_traces: int, seed: int = 0, n_spans: int = 20, p_retry: float = 0.6, p_error: float = 0.15, depth: int = 3) -> DataFrame:
    """Spans of ``n_traces`` traces; every trace has a seed of its own, so tasks make them apart."""

    def run(batches):
        for pdf in batches:
            rows = [r for i in pdf["id"] for r in _trace(f"trace{seed}-{i:04d}", f"{seed}/{i}", n_spans, depth, p_error, p_retry)]
            yield pd.DataFrame(rows, columns=["trace", "id", "name", "parent", "start_ms", "end_ms", "status", "attempt", "attrs"])

    return spark.range(n_traces).mapInPandas(run, SPAN)


def trace_log(spans: DataFrame) -> DataFrame:
    """trace and text: start and end lines in order of time."""
    attrs = F.array_join(F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(F.lit(" "), e["key"], F.lit("="), e["value"])), "")
    c = F.col
    first = F.format_string("t=%07dms START %s id=%s parent=%s attempt=%d", "start_ms", "name", "id", F.coalesce("parent", F.lit("-")), "attempt")
    last = F.concat(F.format_string("t=%07dms END %s id=%s status=%s duration=%dms", "end_ms", "name", "id", "status", c("end_ms") - c("start_ms")), attrs)
    lines = F.array(F.struct(c("start_ms").alias("ms"), F.lit(0).alias("k"), c("id").alias("id"), first.alias("line")), F.struct(c("end_ms").alias("ms"), F.lit(1).alias("k"), c("id").alias("id"), last.alias("line")))
    every = spans.select("trace", F.explode(lines).alias("l")).groupBy("trace").agg(F.array_sort(F.collect_list("l")).alias("l"))
    return every.select("trace", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def trace_json(spans: DataFrame) -> DataFrame:
    """trace and text: a JSON list of spans by start."""
    s = F.struct("start_ms", "id", "name", "parent", "end_ms", "status", "attempt", "attrs", (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    return spans.groupBy("trace").agg(F.to_json(F.array_sort(F.collect_list(s))).alias("text"))


def trace_tree(spans: DataFrame) -> DataFrame:
    """trace and text: spans indented below their parents, by a recursive query over paths."""
    spans.createOrReplaceTempView("_spans")
    walked = spans.sparkSession.sql("""WITH RECURSIVE walk(trace, id, depth, path) AS (
        SELECT trace, id, 0, format_string('%07d%s', start_ms, id) FROM _spans WHERE parent IS NULL
        UNION ALL SELECT s.trace, s.id, w.depth + 1, concat(w.path, '/', format_string('%07d%s', s.start_ms, s.id)) FROM _spans s JOIN walk w ON s.trace = w.trace AND s.parent = w.id)
        SELECT trace, id, depth, path FROM walk""")
    line = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.format_string("%s [%s] %d ms %s", "name", "id", F.col("end_ms") - F.col("start_ms"), "status"), F.when(F.col("attempt") > 1, F.format_string(" attempt=%d", "attempt")).otherwise(""))
    rows = walked.join(spans, ["trace", "id"]).groupBy("trace").agg(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))).alias("l"))
    return rows.select("trace", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def trace_questions(spans: DataFrame) -> DataFrame:
    """trace, type, question, gold and grader: every gold is an aggregate over the spans.

    Types: count, slowest, first_fail, any_fail, parent, retries, total_ms, failed_ids, attr, absent.
    What a question is about is picked by hash; a type without one answer in a trace is left out.
    """
    c = F.col
    body = spans.where("parent IS NOT NULL").withColumn("ms", c("end_ms") - c("start_ms"))
    pick = F.xxhash64("trace", "name")
    row = lambda t, q, g, spec: (F.lit(t).alias("type"), q.alias("question"), g.cast("string").alias("gold"), F.lit(spec).alias("grader"))
    per = body.groupBy("trace", "name").agg(F.count("*").alias("n"), F.sum("ms").alias("total"), F.max("attempt").alias("tries"))
    chosen = per.withColumn("_r", F.row_number().over(Window.partitionBy("trace").orderBy(pick, "name"))).where("_r = 1")
    out = [
        chosen.select("trace", *row("count", F.format_string("How often did %s run, retries included?", "name"), c("n"), "numeric")),
        chosen.select("trace", *row("total_ms", F.format_string("How many milliseconds did all runs of %s take together?", "name"), c("total"), "numeric")),
    ]
    retried = per.where("tries > 1").withColumn("_r", F.row_number().over(Window.partitionBy("trace").orderBy(pick, "name"))).where("_r = 1")
    out.append(retried.select("trace", *row("retries", F.format_string("How many retries did %s need?", "name"), c("tries") - 1, "numeric")))
    whole = body.groupBy("trace").agg(
        F.max_by("name", F.struct("ms", "id")).alias("slow"), F.max("ms").alias("top"), F.collect_list("ms").alias("all"),
        F.count_if(c("status") == "error").alias("failed"), F.min_by("name", F.when(c("status") == "error", F.struct("end_ms", "id"))).alias("first"),
        F.array_sort(F.collect_list(F.when(c("status") == "error", c("id")))).alias("ids"),
    )
    out.append(whole.where(F.size(F.filter("all", lambda m: m == F.col("top"))) == 1).select("trace", *row("slowest", F.lit("Which operation took longest, apart from the job itself?"), c("slow"), "label")))
    out.append(whole.select("trace", *row("any_fail", F.lit("Did an operation fail? Answer yes or no."), F.when(c("failed") > 0, "yes").otherwise("no"), "yes_no")))
    out.append(whole.where("failed > 0").select("trace", *row("first_fail", F.lit("Which operation failed first?"), c("first"), "label")))
    out.append(whole.where("failed > 0").select("trace", *row("failed_ids", F.lit("Which spans failed? Give their ids."), F.array_join("ids", ","), "set_f1")))
    one = body.withColumn("_r", F.row_number().over(Window.partitionBy("trace").orderBy(F.xxhash64("trace", "id"), "id")))
    out.append(one.where("_r = 1").select("trace", *row("parent", F.format_string("Which span started span %s?", "id"), c("parent"), "exact")))
    keys = F.array_sort(F.map_keys("attrs"))
    have = body.where(F.size("attrs") > 0).withColumn("_r", F.row_number().over(Window.partitionBy("trace").orderBy(F.xxhash64("trace", "id"), "id"))).where("_r = 1").withColumn("k", keys[0])
    out.append(have.select("trace", *row("attr", F.format_string("What was %s of span %s?", "k", "id"), F.element_at("attrs", c("k")), "numeric")))
    lacking = F.array_except(F.array(*[F.lit(a) for a in ATTRIBUTES]), F.map_keys("attrs"))
    out.append(one.where("_r = 1").withColumn("k", lacking[0]).select("trace", *row("absent", F.format_string("What was %s of span %s? If the trace does not say, say so.", "k", "id"), F.lit(None), "abstain")))
    made = out[0]
    for o in out[1:]:
        made = made.unionByName(o)
    return made


# == a small world ==


def _word(rng: random.Random) -> str:
    return ("".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(2)) + rng.choice(["", "n", "l", "r", "s"])).capitalize()


def world(spark: SparkSession, n_towns: int = 20, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(facts, docs): towns in pairs of near names, a river per pair, a person born in each town."""
    rng, used, facts = random.Random(seed), set(), []

    def fresh() -> str:
        while (w := _word(rng)) in used:
            pass
        used.add(w)
        return w

    towns: list[tuple[str, int, str]] = []
    while len(towns) < n_towns:
        stem, river = fresh(), fresh()
        for name in (stem, stem + "ford")[: n_towns - len(towns)]:
            towns.append((name, rng.randrange(800, 90_000, 10), river))
    sources: dict[str, str] = {}
    for name, _, river in towns:
        sources.setdefault(river, name)
    for i, (name, people, river) in enumerate(towns):
        facts.append((f"town{i:03d}", "town", name, str(people), river, f"{name} is a town of {people:,} people. The {river} flows through it."))
        born = f"{fresh()} {fresh()}"
        facts.append((f"person{i:03d}", "person", born, name, None, f"{born}, a surveyor, was born in {name}."))
    facts += [(f"river{i:03d}", "river", r, t, None, f"The {r} is a river that rises in {t}.") for i, (r, t) in enumerate(sources.items())]
    table = spark.createDataFrame(facts, "doc_id string, kind string, name string, value string, river string, text string")
    return table.drop("text"), table.select("doc_id", "text")


def world_questions(facts: DataFrame) -> DataFrame:
    """type, question, gold, grader and gold_docs; two-hop golds are joins of the facts."""
    town = facts.where("kind = 'town'").select(F.col("name").alias("town"), F.col("value").alias("people"), F.col("river").alias("flows"), F.col("doc_id").alias("tdoc"))
    kind = lambda k: facts.where(F.col("kind") == k).select("name", F.col("value").alias("town"), "doc_id").join(town, "town")
    row = lambda t, q, g, s, d: (F.lit(t).alias("type"), q.alias("question"), g.alias("gold"), F.lit(s).alias("grader"), F.array(*d).alias("gold_docs"))
    a = town.select(*row("pop", F.format_string("How many people live in %s?", "town"), F.col("people"), "numeric", ["tdoc"]))
    b = kind("river").select(*row("river_pop", F.format_string("How many people live in the town where the %s rises?", "name"), F.col("people"), "numeric", ["doc_id", "tdoc"]))
    c = kind("person").select(*row("person_river", F.format_string("Which river flows through the town where %s was born?", "name"), F.col("flows"), "label", ["doc_id", "tdoc"]))
    return a.unionByName(b).unionByName(c)
