"""What happened in a run, from its event log: runs, states, errors, latency, tokens, stalls, retries.

Events have ``t`` (timestamp), ``event`` and the columns of their kind. Each function gives a small
table; none brings the log to the driver.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.text import error_kind


def seconds(later: Column, earlier: Column) -> Column:
    """Seconds between two moments, with or without a time zone."""
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 1e6


def column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def run_index(events: DataFrame, start: str = "run_start") -> DataFrame:
    """Events with ``run``: how many runs had started by then, that moment included; 0 before the first.

    Hours are counted apart and the starts of earlier hours carried in, so the log is never ordered
    in one task.
    """
    flag = (F.col("event") == start).cast("bigint")
    hour = events.withColumn("_d", F.date_trunc("hour", "t"))
    per = hour.groupBy("_d").agg(F.sum(flag).alias("_n"))
    before = Window.orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)  # one row per hour
    carried = per.select("_d", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"))
    within = F.sum(flag).over(Window.partitionBy("_d").orderBy("t"))
    return hour.join(carried, "_d").withColumn("run", F.col("_c") + within).drop("_d", "_c")


def runs(events: DataFrame) -> DataFrame:
    """One row per run: start, whether it ended, last event, seconds, units planned, to go and done."""
    e = run_index(events).where("run > 0")
    c = F.col
    is_ = lambda kind: c("event") == kind
    out = e.groupBy("run").agg(
        F.min(F.when(is_("run_start"), c("t"))).alias("started"), F.count_if(is_("run_end")).alias("_ends"), F.min(F.when(is_("run_end"), c("t"))).alias("_end"),
        F.max(F.when(is_("unit"), c("t"))).alias("_unit"), F.count_if(is_("unit")).alias("units_done"),
        F.min_by(column(e, "n_units", "bigint"), F.when(is_("run_start"), c("t"))).alias("planned"), F.min_by(column(e, "to_go", "bigint"), F.when(is_("run_start"), c("t"))).alias("to_go"),
    )
    out = out.withColumn("last_event", F.coalesce("_end", "_unit", "started"))
    return out.select("run", "started", (c("_ends") > 0).alias("ended"), "last_event", seconds(c("last_event"), c("started")).alias("elapsed_s"), "planned", "to_go", "units_done")


def status_counts(events: DataFrame) -> DataFrame:
    return events.where("event = 'unit'").groupBy("status").agg(F.count("*").alias("n"))


def error_kinds(events: DataFrame, order: str = "t") -> DataFrame:
    """Errors of units by masked message: count, first example, first and last time."""
    errors = events.where("event = 'unit' AND error IS NOT NULL")
    return errors.groupBy(error_kind(F.col("error")).alias("kind")).agg(F.count("*").alias("n"), F.min_by("error", order).alias("example"), F.min("t").alias("first"), F.max("t").alias("last"))


def latency(events: DataFrame) -> DataFrame:
    """Exact median and 95th percentile, linear between neighbours."""
    q = F.percentile("latency_s", F.array(F.lit(0.5), F.lit(0.95)))
    return events.where("event = 'unit'").agg(q.alias("q")).select(F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"))


def tokens(events: DataFrame, prices: Mapping[str, float] | None = None) -> DataFrame:
    units = events.where("event = 'unit'")
    total = lambda n: F.coalesce(F.sum(F.coalesce(F.nanvl(column(units, n, "double"), F.lit(0.0)), F.lit(0.0))), F.lit(0.0)).alias(n)
    out = units.agg(total("in_tokens"), total("out_tokens"))
    if prices:
        out = out.withColumn("cost", (F.col("in_tokens") * prices["in"] + F.col("out_tokens") * prices["out"]) / 1e6)
    return out


def gaps(events: DataFrame, by: str | None = None) -> DataFrame:
    """Each unit event with the seconds since the one before.

    Hours are ordered apart and the last time of earlier hours is carried in, so the log is never
    ordered in one task.
    """
    units = events.where("event = 'unit'") if by is None else events
    keys = [by] if by else []
    day = units.select(*keys, "t").withColumn("_d", F.date_trunc("hour", "t"))
    last = day.groupBy(*keys, "_d").agg(F.max("t").alias("_last"))
    carried = last.select(*keys, "_d", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_d")).alias("_before"))  # one row per hour
    joined = day.join(carried, [*keys, "_d"])
    before = F.coalesce(F.lag("t").over(Window.partitionBy(*keys, "_d").orderBy("t")), F.col("_before"))
    return joined.select(*keys, "t", before.alias("after"), seconds(F.col("t"), before).alias("gap_s"))


def stalls(events: DataFrame, stall_s: float = 300.0, by: str | None = None) -> DataFrame:
    return gaps(events, by).where(F.col("gap_s") > stall_s).select(*([by] if by else []), "after", "gap_s")


def per_minute(events: DataFrame) -> DataFrame:
    return events.where("event = 'unit'").groupBy(F.date_trunc("minute", "t").alias("minute")).agg(F.count("*").alias("n"))


def throughput(events: DataFrame) -> DataFrame:
    """Median, least and most units of the minutes that had any."""
    return per_minute(events).agg(F.percentile("n", F.lit(0.5)).alias("median"), F.min("n").alias("min"), F.max("n").alias("max"))


def retries(events: DataFrame) -> DataFrame:
    """The five most frequent reasons of retries, with counts and seconds waited."""
    r = events.where("event = 'retry'")
    found = r.groupBy(error_kind(column(r, "reason", "string")).alias("kind")).agg(F.count("*").alias("n"), F.sum(column(r, "wait_s", "double")).alias("wait_s"), F.count(column(r, "server_wait_s", "double")).alias("server_requested"))
    return found.orderBy(F.desc("n"), "kind").limit(5)


def summarize_events(events: DataFrame, prices: Mapping[str, float] | None = None, stall_s: float = 300.0) -> dict[str, DataFrame]:
    """All tables about a run by name."""
    return {
        "runs": runs(events), "status_counts": status_counts(events), "errors": error_kinds(events), "latency_s": latency(events), "tokens": tokens(events, prices),
        "stalls": stalls(events, stall_s), "units_per_minute": throughput(events), "retries": retries(events),
    }


def format_summary(tables: Mapping[str, DataFrame], lines: int = 5) -> str:
    """A short text for people, at most ``lines`` rows of each table."""
    out = []
    for name, df in tables.items():
        rows = df.limit(lines).collect()
        out.append(f"{name}:" + ("" if rows else " none"))
        out += ["  " + ", ".join(f"{k}={v}" for k, v in r.asDict().items()) for r in rows]
    return "\n".join(out)
