"""Plans: cells of a grid, units, and what is left to do."""

from __future__ import annotations

import itertools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.columns import require
from plumbline.operators.accounting import first_rows
from plumbline.plans.identity import cell_id, with_unit_ids

RESERVED = tuple("batch_size cached cell_id cluster error group item_id parse_error plan_seq repeat request_key score_version seq status text unit_id".split())


def grid_of(spark: SparkSession, axes: Mapping[str, Sequence], exclude: Sequence[Mapping] = (), tags: Mapping[str, str] | None = None) -> DataFrame:
    """Cells of the product of axes, in axis order, without those that match a pattern.

    Columns: cell_seq, cell_id, each axis and each tag that no axis shadows. Tags are no part of the id.
    """
    unknown = {k for e in exclude for k in e} - set(axes)
    if unknown:
        raise ValueError(f"a pattern names {sorted(unknown)}, which are no axes")
    clash = (set(axes) | set(tags or {})) & set(RESERVED)
    if clash:
        raise ValueError(f"{sorted(clash)} are reserved names")
    cells = []
    for values in itertools.product(*axes.values()):
        params = dict(zip(axes, values))
        if not any(all(params[k] == v for k, v in e.items()) for e in exclude):
            cells.append({"cell_seq": len(cells), "cell_id": cell_id(params), **(tags or {}), **params})
    return spark.createDataFrame(cells)


def grid(tables: Sequence[DataFrame], exclude: Column | None = None) -> DataFrame:
    """The product of axis tables without the rows of ``exclude``."""
    out = tables[0]
    for t in tables[1:]:
        out = out.crossJoin(t)
    return out if exclude is None else out.where(~F.coalesce(exclude, F.lit(False)))


def with_clusters(items: DataFrame) -> DataFrame:
    """Items with ``cluster``: the parent's id, or their own where that is missing or empty."""
    return items.withColumn("cluster", F.coalesce(F.nullif("parent_id", F.lit("")), "item_id"))


def units(cells: DataFrame, items: DataFrame, repeats: int = 1, item_order: str = "item_seq") -> DataFrame:
    """Units by cell, item and repeat, with an ordinal of that order and their ids."""
    if repeats < 1:
        raise ValueError("there is at least one repeat")
    out = items.crossJoin(F.broadcast(cells)).withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    n = items.agg(F.max(item_order)).first()[0]
    seq = (F.col("cell_seq").cast("bigint") * (0 if n is None else n + 1) + F.col(item_order)) * repeats + F.col("repeat")
    return with_unit_ids(out.withColumn("plan_seq", seq))


def limited(plan: DataFrame, n: int) -> DataFrame:
    """The first n units of the plan."""
    return plan.orderBy("plan_seq").limit(n)


def check_units(plan: DataFrame, items: DataFrame) -> DataFrame:
    """``plan`` itself, refused where it is empty, repeats a unit or names an item that is not there."""
    n = plan.agg(F.count("*").alias("n"), F.count_distinct("unit_id").alias("d")).first()
    if n["n"] == 0 or n["n"] != n["d"]:
        raise ValueError("the plan is empty" if n["n"] == 0 else "a unit is planned twice")
    if not plan.join(items, "item_id", "left_anti").isEmpty():
        raise ValueError("the plan names an item that is not there")
    return plan


def one_content(units_: DataFrame, content: str) -> DataFrame:
    """One row per unit; two contents under one id are refused."""
    one = require(F.count_distinct(content) == 1, "one unit id has two contents", F.first(content))
    return units_.groupBy("unit_id").agg(one.alias(content))


def resume(plan: DataFrame, latest: DataFrame, score_version: str | None = None, retry_errors: bool = True, resume_: bool = True, batch_size: int | None = None) -> DataFrame:
    """``plan`` (unit_id, request_key) with a ``decision`` from the latest rows of the sink.

    ``call`` for units not seen, ``retry`` after an error, ``stale`` where the request or, for local
    models, the batch size changed, ``rescore`` where only the scorer did, else ``done``.
    """
    columns = {"request_key": "string", "error": "string", "batch_size": "int", "score_version": "string"}
    seen = latest.select("unit_id", F.lit(True).alias("_seen"), *[(F.col(c) if c in latest.columns else F.lit(None)).cast(k).alias(f"_{c}") for c, k in columns.items()])
    c = F.col
    decision = F.when(c("_seen").isNull() | F.lit(not resume_), "call").when(c("_error").isNotNull() & F.lit(retry_errors), "retry").when(~c("_request_key").eqNullSafe(c("request_key")), "stale")
    if batch_size is not None:
        decision = decision.when(~c("_batch_size").eqNullSafe(F.lit(batch_size)), "stale")
    if score_version is not None:
        decision = decision.when(~c("_score_version").eqNullSafe(F.lit(score_version)) & c("_error").isNull(), "rescore")
    return plan.join(seen, "unit_id", "left").withColumn("decision", decision.otherwise("done")).drop("_seen", *[f"_{k}" for k in columns])


def plan_counts(decided: DataFrame) -> DataFrame:
    """One row: units, to call, retried, stale, rescored and done; a rescored unit is done."""
    c = F.col("decision")
    return decided.agg(
        F.count("*").alias("n_units"), F.count_if(c.isin("call", "retry", "stale")).alias("to_go"), F.count_if(c == "retry").alias("retried"),
        F.count_if(c == "stale").alias("stale"), F.count_if(c == "rescore").alias("rescored"), F.count_if(c.isin("done", "rescore")).alias("done"),
    )


def manifest(plan: DataFrame) -> DataFrame:
    return first_rows(plan, "unit_id", ("plan_seq",))


def cost(decided: DataFrame, cache: DataFrame | None, in_tokens: float, out_tokens: float, prices: Mapping[str, float]) -> DataFrame:
    """One row: requests to call that no cache answers, and what they are expected to cost."""
    todo = decided.where(F.col("decision").isin("call", "retry", "stale"))
    if cache is not None:
        todo = todo.join(cache.select("request_key"), "request_key", "left_anti")
    each = (in_tokens * prices["in"] + out_tokens * prices["out"]) / 1e6
    return todo.agg(F.count("*").alias("to_call")).withColumn("cost", F.col("to_call") * each)


def modal_batch_size(rows: DataFrame) -> DataFrame:
    """One row: the most frequent batch size of a sink, the least of equals."""
    n = rows.where("batch_size IS NOT NULL").groupBy("batch_size").count()
    return n.agg(F.max_by("batch_size", F.struct("count", -F.col("batch_size"))).alias("batch_size"))
