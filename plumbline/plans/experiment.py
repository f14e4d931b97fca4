"""Experiments from a configuration: plan, dry run, execute, analyse, report."""

from __future__ import annotations

import hashlib
import importlib.util
import inspect
import json
import os
import platform
import subprocess
import sys
import tempfile
from collections.abc import Callable
from dataclasses import dataclass, field
from importlib import metadata
from pathlib import Path
from typing import Any

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.graders import grade
from plumbline.operators import accounting, curves, retrieval, statistics
from plumbline.plans import execution, generators, grid
from plumbline.plans.identity import digest
from plumbline.sources.tasks import load_tasks

REGISTRY: dict[str, dict[str, Callable]] = {}
ROOT = Path(__file__).resolve().parents[1]
STAGES = ("plan", "dry_run", "execute", "analyse", "report")


class ConfigError(ValueError):
    """A configuration that names or configures something wrongly."""


def register(kind: str, name: str, replace: bool = False):
    """Register a factory; its signature is its schema, keyword-only arguments are given by the pipeline."""

    def add(f: Callable) -> Callable:
        own = REGISTRY.setdefault(kind, {})
        if name in own and not replace:
            raise ValueError(f"there is a {kind} {name!r}")
        own[name] = f
        return f

    return add


def build(kind: str, spec: str | dict, **context: Any) -> Any:
    """Make a component from its name or ``{"name": ..., arguments}``."""
    args = {"name": spec} if isinstance(spec, str) else dict(spec)
    name = args.pop("name", None)
    known = REGISTRY.get(kind, {})
    if name not in known:
        raise ConfigError(f"no {kind} {name!r}; there are {sorted(known)}")
    params = inspect.signature(known[name]).parameters
    own = {n for n, p in params.items() if p.kind != p.KEYWORD_ONLY}
    injected = {n: context[n] for n, p in params.items() if p.kind == p.KEYWORD_ONLY and n in context}
    unknown = set(args) - own
    missing = {n for n in own if params[n].default is inspect.Parameter.empty} - set(args)
    if unknown or missing:
        raise ConfigError(f"{kind} {name!r}: unknown {sorted(unknown)}, missing {sorted(missing)}")
    return known[name](**args, **injected)


@register("backend", "echo")
def _echo() -> execution.Backend:
    return execution.Echo()


@register("task", "file")
def _file(path: str, *, spark: SparkSession) -> DataFrame:
    return load_tasks(spark, path)


@register("task", "arithmetic")
def _arithmetic(digits: int = 2, n_items: int = 64, n_shots: int = 4, op: str = "+", seed: int = 0, *, spark: SparkSession) -> DataFrame:
    return generators.sum_items(spark, digits=digits, n_items=n_items, n_shots=n_shots, op=op, seed=seed)


@register("task", "log_qa")
def _log_qa(n_traces: int = 10, seed: int = 0, types: list[str] | None = None, *, spark: SparkSession) -> DataFrame:
    spans = generators.traces(spark, n_traces, seed)
    q = generators.trace_questions(spans).join(generators.trace_log(spans), "trace")
    q = q if types is None else q.where(F.col("type").isin(*types))
    return q.select(F.concat_ws("-", "trace", "type").alias("id"), F.concat_ws("\n\n", F.col("text"), F.col("question")).alias("prompt"), "gold", "grader", F.col("trace").alias("cluster"), F.col("type").alias("group"))


@register("analysis", "attrition")
def _attrition(*, rows: DataFrame, plan: DataFrame, by: list[str]) -> DataFrame:
    return accounting.attrition(rows, by, plan)


@register("analysis", "summary")
def _summary(metric: str = "correct", n_boot: int = 5000, *, rows: DataFrame, by: list[str]) -> DataFrame:
    return statistics.summarize(rows, metric, by, n_boot=n_boot)


@register("analysis", "retrieval")
def _retrieval(metrics: tuple = (), n_boot: int = 5000, *, rows: DataFrame, by: list[str]) -> DataFrame:
    named = list(metrics) or [c for c in rows.columns if c == "rr" or c.startswith(("recall@", "hit@", "ndcg@"))]
    return retrieval.retrieval_summary(rows, by, named, n_boot=n_boot)


@register("analysis", "value_curve")
def _value_curve(x: str, metric: str = "correct", levels: tuple = (), log_x: bool = True, *, rows: DataFrame, by: list[str]) -> DataFrame:
    return curves.value_curves(rows, x, metric, [b for b in by if b != x], levels=levels, log_x=log_x)


@register("analysis", "axis_curve")
def _axis_curve(x: str, ok: str = "argmax_ok", log_x: bool = True, *, rows: DataFrame, by: list[str]) -> DataFrame:
    return curves.axis_curves(rows, x, ok, [b for b in by if b != x], log_x=log_x)


@dataclass
class Experiment:
    """What to ask, of whom, over which grid, and what to make of it."""

    items: DataFrame
    axes: dict[str, list]
    backend: execution.Backend
    folder: str
    graders: dict[str, Any]
    repeats: int = 1
    exclude: list[dict] = field(default_factory=list)
    analyses: dict[str, Any] = field(default_factory=lambda: {"attrition": "attrition", "summary": "summary"})
    prices: dict[str, float] | None = None
    max_cost: float | None = None
    tokens: tuple[float, float] = (500.0, 200.0)
    config: dict[str, Any] | None = None

    def plan(self) -> DataFrame:
        spark = self.items.sparkSession
        cells = grid.grid_of(spark, self.axes, self.exclude)
        columns = [c for c in ("prompt", "gold", "grader", "group") if c in self.items.columns]
        cluster = F.coalesce(F.nullif("cluster", F.lit("")), "id") if "cluster" in self.items.columns else F.col("id")
        items = self.items.select(F.col("id").alias("item_id"), cluster.alias("cluster"), *columns)
        order = items.select("item_id").distinct().withColumn("item_seq", F.xxhash64("item_id"))
        first = order.agg(F.min("item_seq")).first()[0] or 0
        items = items.join(order.withColumn("item_seq", F.col("item_seq").cast("decimal(20,0)") - first), "item_id")
        return grid.units(cells, items.withColumn("item_seq", F.col("item_seq").cast("double")), self.repeats).drop("item_seq", "cell_seq")

    def run(self, stages: tuple[str, ...] = STAGES) -> dict[str, Any]:
        """All stages in order; a dry run over the allowed cost ends before any call."""
        spark, out = self.items.sparkSession, {}
        run, by = execution.Run(self.folder), list(self.axes)
        plan = self.plan()
        out["plan"] = plan
        if "dry_run" in stages and self.prices:
            keyed = execution.with_request_keys(plan, self.backend, by).withColumn("decision", F.lit("call"))
            out["dry_run"] = grid.cost(keyed, run.table(spark, "cache"), *self.tokens, self.prices).first().asDict()
            if self.max_cost is not None and out["dry_run"]["cost"] > self.max_cost:
                out["halted"] = f"the run may cost {out['dry_run']['cost']:.2f}"
                self.report(out)
                return out
        if "execute" in stages:
            out["rows"] = execution.execute(plan, self.backend, score_rows_column(self.graders), run, by)
        if "analyse" in stages and "rows" in out:
            out["tables"] = {n: build("analysis", spec, rows=out["rows"], plan=plan, by=by) for n, spec in self.analyses.items()}
            for n, table in out["tables"].items():
                table.write.mode("overwrite").parquet(f"{self.folder}/analysis/{n}")
                write_csv(spark.read.parquet(f"{self.folder}/analysis/{n}"), f"{self.folder}/analysis/{n}.csv")
            out["job"] = accounting.job_status(plan, out["rows"]).first().asDict()
        if "report" in stages:
            self.report(out)
        return out

    def report(self, out: dict[str, Any]) -> None:
        """Where the numbers come from, as one small JSON file."""
        facts = {**provenance(), "axes": self.axes, "repeats": self.repeats, "backend": self.backend.identity, "job": out.get("job"), "dry_run": out.get("dry_run"), "halted": out.get("halted")}
        folder = self.folder.removeprefix("file://")
        if "://" not in folder:
            os.makedirs(folder, exist_ok=True)
            write_atomic(f"{folder}/run.json", json.dumps(facts, indent=1, default=str))
            if self.config is not None:
                write_atomic(f"{folder}/config.json", json.dumps(self.config, indent=1))
            patch = _git("diff", "HEAD")
            if patch:
                write_atomic(f"{folder}/changes.patch", patch)


def write_csv(table: DataFrame, path: str) -> None:
    """An analysis as one CSV file in a folder; arrays and structs as JSON."""
    nested = [f.name for f in table.schema if f.dataType.typeName() in ("array", "map", "struct")]
    flat = table.select(*[F.to_json(F.col(f"`{c}`")).alias(c) if c in nested else F.col(f"`{c}`") for c in table.columns])
    flat.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def _git(*args: str) -> str | None:
    """What git says of the checkout this package is in; None outside one."""
    try:
        return subprocess.run(["git", *args], cwd=ROOT, capture_output=True, text=True, timeout=30, check=True).stdout
    except (OSError, subprocess.SubprocessError):
        return None


def source_digest() -> str:
    """The digest of the package's own source files."""
    files = sorted(p for p in ROOT.rglob("*.py"))
    return digest({str(p.relative_to(ROOT)): hashlib.sha256(p.read_bytes()).hexdigest() for p in files})


def provenance() -> dict[str, Any]:
    """Commit, whether it was changed, versions, the script that runs, and a digest of the code."""
    commit, changed = _git("rev-parse", "HEAD"), _git("status", "--porcelain", "--untracked-files=no")
    versions = {}
    for name in ("numpy", "pandas", "pyarrow", "pyspark"):
        try:
            versions[name] = metadata.version(name)
        except metadata.PackageNotFoundError:
            versions[name] = None
    return {"commit": commit.strip() if commit else None, "changed": bool(changed), "source": source_digest(), "script": sys.argv[0] or None, "spark": pyspark.__version__, "python": platform.python_version(), "versions": versions}


def load_plugins(names: list[str], base: str) -> None:
    """Import modules by name, or by the path of a .py file beside the configuration, so that they can register."""
    for name in names:
        if not name.endswith(".py"):
            importlib.import_module(name)
            continue
        path = os.path.join(base, name)
        if not os.path.isfile(path):
            raise ConfigError(f"there is no plug-in {path}")
        spec = importlib.util.spec_from_file_location(f"plumbline_plugin_{os.path.basename(name)[:-3]}", path)
        module = importlib.util.module_from_spec(spec)
        sys.modules[spec.name] = module
        spec.loader.exec_module(module)


def score_rows_column(specs: dict[str, Any]):
    """The grade of a row by the grader it names, as a column of its text and gold."""
    correct = F.lit(None).cast("double")
    for name, spec in specs.items():
        correct = F.when(F.col("grader") == name, grade(spec, F.col("text"), F.col("gold"))["correct"]).otherwise(correct)
    return correct


def write_atomic(path: str, text: str) -> None:
    """A driver's file appears whole: written beside its place and renamed."""
    at, temporary = tempfile.mkstemp(dir=os.path.dirname(path) or ".")
    with os.fdopen(at, "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(temporary, path)


def from_config(spark: SparkSession, path: str) -> Experiment:
    """An experiment from a JSON file; keys that are not known are refused."""
    with open(path, encoding="utf-8") as f:
        config = json.load(f)
    known = {"task", "backend", "axes", "exclude", "repeats", "out", "graders", "analyses", "prices", "max_cost", "plugins"}
    if set(config) - known or not {"task", "backend", "axes", "out"} <= set(config):
        raise ConfigError(f"unknown keys {sorted(set(config) - known)}, missing {sorted({'task', 'backend', 'axes', 'out'} - set(config))}")
    load_plugins(config.get("plugins", []), os.path.dirname(os.path.abspath(path)))
    extra = {"config": config} | {k: config[k] for k in ("exclude", "repeats", "analyses", "prices", "max_cost") if k in config}
    return Experiment(build("task", config["task"], spark=spark), config["axes"], build("backend", config["backend"], spark=spark), config["out"], config.get("graders", {"exact": "exact", "numeric": "numeric", "yes_no": "yes_no"}), **extra)


__all__ = ["REGISTRY", "STAGES", "ConfigError", "Experiment", "build", "from_config", "register", "score_rows_column", "write_atomic"]
