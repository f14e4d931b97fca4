"""Latest rows, row states and the accounting of planned units.

n_planned = n_completed + n_err + n_tool_error + n_truncated + n_unparsed + n_missing holds for
every group, because the state of a unit is decided once, on the side of the plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import ratio, require

#: States of a row by severity; the worst row of a unit decides its state.
STATES = ("ok", "unparsed", "truncated", "tool_error", "error")


def _one_row(rows: DataFrame, key: str | Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    pick = F.max_by if last else F.min_by
    best = pick(F.struct(*rows.columns), F.struct(*order)).alias("row")
    return rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(best).select("row.*")


def latest_rows(rows: DataFrame, key: str | Sequence[str] = "unit_id", order: Sequence[str] = ("seq",)) -> DataFrame:
    """The last row of each key by ``order``, which must tell all rows of a key apart.

    An aggregate and not a window: rows of a key are reduced before the shuffle. Rows without a key
    are no records and go.
    """
    return _one_row(rows, key, order, True)


def first_rows(rows: DataFrame, key: str | Sequence[str] = "unit_id", order: Sequence[str] = ("seq",)) -> DataFrame:
    """The first row of each key: a plan's record is the one that was written first."""
    return _one_row(rows, key, order, False)


def row_status(status: Column, error: Column) -> Column:
    """``ok`` where there is none; any error makes a row ``error`` unless it is a kind of error already."""
    known = F.coalesce(status, F.lit("ok"))
    return F.when(error.isNotNull() & ~known.isin("error", "tool_error"), "error").otherwise(known)


def severity(status: Column) -> Column:
    """0 to 4; a status outside of ``STATES`` is an error."""
    rank = F.lit(None).cast("int")
    for i, s in reversed(list(enumerate(STATES))):
        rank = F.when(status == s, i).otherwise(rank)
    return require(status.isin(*STATES), f"a status is none of {', '.join(STATES)}", rank)


def attrition(rows: DataFrame, by: Sequence[str], plan: DataFrame | None = None) -> DataFrame:
    """What became of every planned unit, per group.

    ``rows`` holds ``by``, ``unit_id`` and, where there, ``status`` and ``error``; ``plan`` holds ``by``
    and ``unit_id``, one row per unit. Without a plan, rows are counted by state. NULL groups are
    groups. err_rate is over attempted units, the other rates over planned ones; NULL over none.
    """
    by = list(by)
    column = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    state = severity(row_status(column("status"), column("error")))
    if plan is None:
        counts = {"n_err": 4, "n_tool_error": 3, "n_truncated": 2, "n_unparsed": 1}
        out = rows.select(*by, state.alias("_rank")).groupBy(*by)
        out = out.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col("_rank") == r).alias(n) for n, r in counts.items()])
        return out.withColumn("err_rate", ratio(F.col("n_err"), F.col("n_rows")))
    missing = [c for c in by if c not in plan.columns]
    if missing:
        raise ValueError(f"the plan has no column {missing}: a unit that was never tried has no scored columns")
    seen = rows.select(*by, "unit_id", state.alias("_rank"))
    worst = seen.groupBy("unit_id").agg(F.max("_rank").alias("_rank"))
    planned = plan.select(*by, "unit_id").join(worst, "unit_id", "left")
    parts = {"n_completed": 0, "n_err": 4, "n_tool_error": 3, "n_truncated": 2, "n_unparsed": 1}
    zero = lambda n: F.lit(0).cast("bigint").alias(n)
    sums = ["n_planned", *parts, "n_missing", "n_rows", "n_unplanned"]
    a = planned.groupBy(*by).agg(
        F.count("*").alias("n_planned"), *[F.count_if(F.col("_rank") == r).alias(n) for n, r in parts.items()],
        F.count_if(F.col("_rank").isNull()).alias("n_missing"),
    ).select(*by, "n_planned", *parts, "n_missing", zero("n_rows"), zero("n_unplanned"))
    stale = seen.join(plan.select("unit_id"), "unit_id", "left_anti").groupBy(*by).agg(F.count_distinct("unit_id").alias("n_unplanned"))
    none = [zero(n) for n in sums[:-2]]
    b = seen.groupBy(*by).agg(F.count("*").alias("n_rows")).select(*by, *none, "n_rows", zero("n_unplanned"))
    c = stale.select(*by, *none, zero("n_rows"), "n_unplanned")
    out = a.union(b).union(c).groupBy(*by).agg(*[F.sum(n).alias(n) for n in sums])
    tried = F.col("n_planned") - F.col("n_missing")
    return out.select(
        *by, "n_planned", "n_rows", "n_completed", "n_err", "n_tool_error", "n_truncated", "n_unparsed", "n_missing", "n_unplanned",
        ratio(F.col("n_err"), tried).alias("err_rate"), ratio(F.col("n_missing"), F.col("n_planned")).alias("missing_rate"),
        (1 - ratio(F.col("n_completed"), F.col("n_planned"))).alias("attrition_rate"),
    )


def job_status(plan: DataFrame, rows: DataFrame) -> DataFrame:
    """One row: planned, missing and bad units, and ``incomplete``, ``complete`` or ``complete_with_errors``.

    ``rows`` are the latest rows with a ``status``.
    """
    joined = plan.select("unit_id").join(rows.select("unit_id", F.coalesce("status", F.lit("ok")).alias("status")), "unit_id", "left")
    n = joined.agg(
        F.count("*").alias("n_planned"), F.count_if(F.col("status").isNull()).alias("n_missing"),
        F.count_if(~F.col("status").isin("ok", "truncated", "unparsed")).alias("n_bad"),
    )
    state = F.when(F.col("n_missing") > 0, "incomplete").when(F.col("n_bad") == 0, "complete").otherwise("complete_with_errors")
    return n.withColumn("job_status", state)
