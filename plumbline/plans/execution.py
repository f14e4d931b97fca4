"""Calling a model once per planned unit, and what a run writes.

Calls are an edge: a backend is a Python object with ``complete(list of requests)``; everything
around it, what to call, what a cache answers, which row is last, is a query. A run appends rows;
the plan is written before the first call, so units that were never tried can be counted.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.accounting import first_rows, latest_rows
from plumbline.plans import grid
from plumbline.plans.identity import digest, request_key
from plumbline.plans.search_tools import Context, Tool
from plumbline.sources.tables import saved

RETRY = "retry_reasons array<string>, retry_waits array<double>, server_waits array<double>"
ANSWER = "text string, error string, truncated boolean, tool_error boolean, in_tokens double, out_tokens double, latency_s double"


class Transient(Exception):
    """Worth another try, perhaps after ``wait`` seconds."""

    def __init__(self, message: str, wait: float | None = None) -> None:
        super().__init__(message)
        self.wait = wait


class Fatal(Exception):
    """Not worth another try."""


class Backend(Protocol):
    """``identity`` names what answers; ``complete`` gives a dict per request, in order."""

    identity: Any

    def complete(self, requests: list[dict]) -> list[dict]: ...


@dataclass
class Echo:
    """Answers with the last message reversed."""

    identity: Any = "echo"

    def complete(self, requests: list[dict]) -> list[dict]:
        return [{"text": r["prompt"][::-1]} for r in requests]


@dataclass
class Function:
    """Answers with a function of the request; what it raises is the row's error."""

    call: Callable[[dict], str | dict]
    name: str = "function"

    @property
    def identity(self) -> Any:
        return {"function": self.name}

    def complete(self, requests: list[dict]) -> list[dict]:
        out = []
        for r in requests:
            try:
                answer = self.call(r)
                out.append(answer if isinstance(answer, dict) else {"text": answer})
            except Transient:
                raise
            except Exception as e:  # noqa: BLE001
                out.append({"error": f"{type(e).__name__}: {e}"})
        return out


def with_retries(call: Callable[[], list[dict]], n: int, attempts: int = 5, sleep=time.sleep, base: float = 1.0, cap: float = 60.0, rng: random.Random | None = None, on_retry: Callable[[str, float, float | None], None] | None = None) -> list[dict]:
    """Full jitter between tries; a wait the server asks for, up to 300 s, is kept to.

    ``on_retry`` is told the reason, the wait and what wait the server asked for, before each further try.
    """
    rng = rng or random.Random()
    for k in range(attempts):
        try:
            return call()
        except Transient as e:
            if k == attempts - 1:
                return [{"error": f"Transient: {e}"}] * n
            wait = min(300.0, e.wait) if e.wait is not None else rng.random() * min(cap, base * (1 << k))
            if on_retry is not None:
                on_retry(f"{e}"[:300], wait, e.wait)
            sleep(wait)
        except Fatal as e:
            return [{"error": f"Fatal: {e}"}] * n
    return [{"error": "no attempt was made"}] * n


@dataclass
class Agent:
    """A loop of turns: the backend answers, tools it names run, until it names none or turns end."""

    backend: Backend
    tools: dict[str, Callable[[dict], str]] = field(default_factory=dict)
    max_turns: int = 8

    @property
    def identity(self) -> Any:
        versions = {n: getattr(t, "version", "") for n, t in self.tools.items()}
        return {"agent": self.backend.identity, "tools": sorted(versions.items()), "max_turns": self.max_turns}

    def complete(self, requests: list[dict]) -> list[dict]:
        return [self._one(dict(r)) for r in requests]

    def _one(self, request: dict) -> dict:
        for _ in range(self.max_turns):
            answer = self.backend.complete([request])[0]
            calls = answer.get("tool_calls") or []
            if answer.get("error") or not calls:
                return answer
            for c in calls:
                if c["name"] not in self.tools:
                    return {"error": f"no tool {c['name']!r}", "tool_error": True}
                tool, context = self.tools[c["name"]], Context(request.get("item_id"), int(request.get("repeat") or 0))
                try:
                    result = tool(c.get("arguments") or {}, context) if isinstance(tool, Tool) else tool(c.get("arguments") or {})
                except Exception as e:  # noqa: BLE001
                    return {"error": f"{type(e).__name__}: {e}", "tool_error": True}
                request["prompt"] = f"{request['prompt']}\n\n{c['name']}: {result}"
        return {"text": answer.get("text"), "truncated": True}


def _call(backend: Backend, columns: Sequence[str], batch_size: int, attempts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for at in range(0, len(pdf), batch_size):
                requests = pdf.iloc[at : at + batch_size].to_dict("records")
                began, tries = time.time(), []
                try:
                    answers = with_retries(lambda: backend.complete(requests), len(requests), attempts, on_retry=lambda *x: tries.append(x))  # noqa: B023
                except Exception as e:  # noqa: BLE001
                    answers = [{"error": f"{type(e).__name__}: {e}"}] * len(requests)
                if len(answers) != len(requests):
                    answers = [{"error": "missing: the backend answered another number of requests"}] * len(requests)
                each = (time.time() - began) / len(requests)
                parts += [{k: a.get(k) for k in ("text", "error", "in_tokens", "out_tokens")} | {"truncated": bool(a.get("truncated")), "tool_error": bool(a.get("tool_error")), "latency_s": each, "retry_reasons": [], "retry_waits": [], "server_waits": []} for a in answers]
                told = [list(x) for x in zip(*tries)] or [[], [], []]
                parts[-len(answers)] |= dict(zip(("retry_reasons", "retry_waits", "server_waits"), told))  # once per batch
            answered = pd.DataFrame(parts, columns=[c.split(" ")[0] for c in f"{ANSWER}, {RETRY}".split(", ")], index=pdf.index)
            yield pd.concat([pdf[list(columns)], answered], axis=1)

    return run


def call_backend(units: DataFrame, backend: Backend, batch_size: int = 1, attempts: int = 5) -> DataFrame:
    """Units (with a ``prompt``) and the backend's answers, one call per unit.

    The result is written before it is used: a second look at it never calls again.
    """
    kinds = {f.name: f.dataType.simpleString() for f in units.schema}
    schema = ", ".join(f"`{c}` {k}" for c, k in kinds.items()) + f", {ANSWER}, {RETRY}"
    return saved(units.mapInPandas(_call(backend, units.columns, batch_size, attempts), schema), "answers")


def with_request_keys(units: DataFrame, backend: Backend, params: Sequence[str] = ()) -> DataFrame:
    """Units with the key of their request: prompt, parameters, backend and repeat."""
    identity, keys = backend.identity, list(params)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf["request_key"] = [request_key({"messages": r["prompt"], "params": {k: r[k] for k in keys}}, identity, int(r["repeat"])) for r in pdf[["prompt", "repeat", *keys]].to_dict("records")]
            yield pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema)
    return units.mapInPandas(run, f"{kinds}, request_key string")


def answer_status(answered: DataFrame, correct: Column) -> DataFrame:
    """Status by the order of the law: tool error, error, truncated, unparsed, ok; scores only where ok."""
    c = F.col
    status = F.when(c("error").isNotNull() & c("tool_error"), "tool_error").when(c("error").isNotNull(), "error").when(c("truncated"), "truncated").when(c("_s").isNull(), "unparsed").otherwise("ok")
    return answered.withColumn("_s", F.when(c("error").isNull() & ~c("truncated"), correct)).withColumn("status", status).withColumn("correct", F.when(c("status") == "ok", c("_s"))).drop("_s")


@dataclass
class Run:
    """Where a run writes: ``rows``, ``plan``, ``cache`` and ``events`` below one folder."""

    folder: str

    def table(self, spark, name: str) -> DataFrame | None:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        return spark.read.option("mergeSchema", "true").parquet(f"{self.folder}/{name}")


EVENT = "t timestamp, event string, unit_id string, status string, cached boolean, latency_s double, in_tokens double, out_tokens double, error string, n_units bigint, to_go bigint, units_done bigint, errors bigint, reason string, wait_s double, server_wait_s double, backend string"


def emit(run: Run, events: DataFrame | dict) -> None:
    """Append events to a run's log: rows, or one event's fields with the present moment."""
    names = [c.split(" ")[0] for c in EVENT.split(", ")]
    if isinstance(events, dict):
        spark = SparkSession.active()
        fields = ", ".join(c for c in EVENT.split(", ") if not c.startswith("t "))
        events = spark.createDataFrame([tuple(events.get(n) for n in names[1:])], fields).withColumn("t", F.current_timestamp())
    types = dict(c.split(" ") for c in EVENT.split(", "))
    events.select(*[(F.col(n) if n in events.columns else F.lit(None)).cast(types[n]).alias(n) for n in names]).write.mode("append").parquet(f"{run.folder}/events")


def execute(plan: DataFrame, backend: Backend, score: Column, run: Run, params: Sequence[str] = (), score_version: str = "1", batch_size: int = 1, attempts: int = 5, retry_errors: bool = True, whole_run: bool = True) -> DataFrame:
    """Plan, record, answer from the cache, call, score, append; returns the latest row of each unit.

    ``plan`` has unit_id, item_id, cluster, repeat, prompt, the parameters and what ``score`` reads. The
    log says when the run starts and ends, unless it is a part of one, what was retried and what became
    of each unit.
    """
    spark = plan.sparkSession
    keyed = saved(with_request_keys(plan, backend, params), "keyed-plan")
    rows, before = run.table(spark, "rows"), run.table(spark, "plan")
    new = keyed if before is None else keyed.join(before.select("unit_id"), "unit_id", "left_anti")
    new.write.mode("append").parquet(f"{run.folder}/plan")
    if rows is None:
        decided, start = keyed.withColumn("decision", F.lit("call")), 0
    else:
        decided = grid.resume(keyed, latest_rows(rows), score_version, retry_errors)
        start = rows.agg(F.max("seq")).first()[0] + 1
    decided = saved(decided, "decisions")
    todo = decided.where(F.col("decision").isin("call", "retry", "stale")).drop("decision")
    if whole_run:
        emit(run, {"event": "run_start", "n_units": keyed.count(), "to_go": todo.count(), "backend": digest(backend.identity)})
    cache = run.table(spark, "cache")
    answers = [c.split(" ")[0] for c in ANSWER.split(", ")]
    hits = None if cache is None else todo.join(first_rows(cache, "request_key", ("request_key", "text")).select("request_key", *answers), "request_key").withColumn("cached", F.lit(True))
    misses = todo if cache is None else todo.join(cache.select("request_key"), "request_key", "left_anti")
    raw = call_backend(misses, backend, batch_size, attempts)
    tries = raw.select(F.explode(F.arrays_zip("retry_reasons", "retry_waits", "server_waits")).alias("r"))
    retried = tries.select(F.current_timestamp().alias("t"), F.lit("retry").alias("event"), F.col("r.retry_reasons").alias("reason"), F.col("r.retry_waits").alias("wait_s"), F.col("r.server_waits").alias("server_wait_s"))
    called = raw.drop(*[c.split(" ")[0] for c in RETRY.split(", ")]).withColumn("cached", F.lit(False))
    called.where("error IS NULL").select("request_key", *answers).write.mode("append").parquet(f"{run.folder}/cache")
    answered = called if hits is None else called.unionByName(hits)
    if rows is not None:
        again = decided.where("decision = 'rescore'").select("unit_id")
        old = latest_rows(rows).join(again, "unit_id", "left_semi").select("unit_id", *answers, "cached")
        answered = answered.unionByName(keyed.join(old, "unit_id").select(*answered.columns))
    made = answer_status(answered, score).withColumn("score_version", F.lit(score_version)).withColumn("batch_size", F.lit(batch_size))
    numbered = made.withColumn("seq", F.monotonically_increasing_id() + F.lit(start))
    numbered = saved(numbered, "numbered")
    numbered.write.mode("append").parquet(f"{run.folder}/rows")
    emit(run, retried)
    emit(run, numbered.select(F.current_timestamp().alias("t"), F.lit("unit").alias("event"), "unit_id", "status", "cached", "latency_s", "in_tokens", "out_tokens", F.left("error", F.lit(300)).alias("error")))
    if whole_run:
        done = numbered.agg(F.count("*").alias("n"), F.count("error").alias("e")).first()
        emit(run, {"event": "run_end", "units_done": done["n"], "errors": done["e"]})
    return latest_rows(run.table(spark, "rows"))


class Runner:
    """A run in parts: units come a few at a time, one start and one end frame them in the log.

    Used as a context; ``run_batch`` answers the units it is given, with all that :func:`execute` knows
    of earlier rows, and a part that is given again calls nothing.
    """

    def __init__(self, backend: Backend, score: Column, run: Run, **options: Any) -> None:
        self.backend, self.score, self.run, self.options, self.seen = backend, score, run, options, 0

    def __enter__(self) -> Runner:
        emit(self.run, {"event": "run_start", "backend": digest(self.backend.identity)})
        return self

    def run_batch(self, units: DataFrame) -> DataFrame:
        """The latest rows of these units."""
        rows = execute(units, self.backend, self.score, self.run, whole_run=False, **self.options)
        own = saved(rows.join(units.select("unit_id"), "unit_id", "left_semi"), "batch")
        self.seen += own.count()
        return own

    def __exit__(self, kind, *_: Any) -> None:
        if kind is None:
            emit(self.run, {"event": "run_end", "units_done": self.seen})


def never_tried(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """Planned units without any row."""
    return plan.join(rows.select("unit_id"), "unit_id", "left_anti")


def job_hash(plan: DataFrame, task: str, version: str, backend: Backend) -> str:
    """The content address of a job; unit and request ids enter as an order-free sum of hashes."""
    s = plan.agg(F.count("*").alias("n"), F.sum(F.xxhash64("unit_id", "request_key").cast("decimal(38,0)")).alias("s"), F.sum(F.xxhash64("request_key", "unit_id", F.lit(1)).cast("decimal(38,0)")).alias("u")).first()
    return digest({"task": task, "version": version, "backend": backend.identity, "units": [s["n"], str(s["s"]), str(s["u"])]})


@dataclass
class Calibration:
    """What a few calls showed: requests per second by batch size, or latency, tokens and limits."""

    throughput: dict[int, float] = field(default_factory=dict)
    latency_s: float | None = None
    tokens_per_call: float = 0.0
    limits: dict[str, float] = field(default_factory=dict)
    n_ok: int = 0
    errors: list[str] = field(default_factory=list)


def calibrate(backend: Backend, requests: list[dict], sizes: Sequence[int] = (1, 2, 4, 8, 16)) -> Calibration:
    """Larger batches while they bring a tenth more."""
    cal, best = Calibration(), 0.0
    for b in sizes:
        if b > len(requests):
            break
        began = time.perf_counter()
        answers = backend.complete(requests[:b])
        rate = b / max(time.perf_counter() - began, 1e-9)
        cal.throughput[b] = rate
        cal.n_ok += sum(not a.get("error") for a in answers)
        cal.errors += [a["error"] for a in answers if a.get("error")]
        if rate * 10 < best * 11:
            break
        best = rate if rate > best else best
    return cal


def derive(cal: Calibration, safety: float = 0.8, max_workers: int = 16) -> dict[str, Any]:
    """Workers and batch size that stay under per-minute limits: W <= safety * R * L / 60."""
    caveats = [f"{len(cal.errors)} calibration calls failed"] if cal.errors else []
    if cal.throughput:
        if len(cal.throughput) == 1:
            caveats.append("one batch size was measured: nothing was compared")
        return {"workers": 1, "batch_size": max(cal.throughput, key=cal.throughput.get), "caveats": caveats}
    if not cal.latency_s:
        return {"workers": 1, "batch_size": 1, "caveats": [*caveats, "no call succeeded"]}
    bounds = [max_workers]
    if "requests" in cal.limits:
        bounds.append(int(safety * cal.limits["requests"] * cal.latency_s / 60))
    if "tokens" in cal.limits and cal.tokens_per_call:
        bounds.append(int(safety * cal.limits["tokens"] / cal.tokens_per_call * cal.latency_s / 60))
    if len(bounds) == 1:
        bounds.append(2)
        caveats.append("no limits are known: two workers to begin with")
    return {"workers": max(1, min(bounds)), "batch_size": 1, "caveats": caveats}


def check_backend(backend: Backend) -> list[str]:
    """Breaches of the contract: an identity that cannot be addressed, answers lost or out of order."""
    faults = []
    try:
        digest(backend.identity)
    except (TypeError, ValueError) as e:
        faults.append(f"the identity cannot be digested: {e}")
    asked = [{"prompt": f"prompt {i}", "repeat": 0} for i in range(3)]
    together = backend.complete(asked)
    if len(together) != 3:
        return [*faults, f"3 requests got {len(together)} answers"]
    if not all(isinstance(a, dict) and ("text" in a or "error" in a) for a in together):
        faults.append("an answer has neither text nor error")
    if [a.get("text") for a in together] != [backend.complete([r])[0].get("text") for r in asked]:
        faults.append("answers depend on the batch or its order")
    return faults
