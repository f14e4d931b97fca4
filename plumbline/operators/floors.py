"""Floors of trivial predictors and the distance to the strongest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import require


def _stated(df: DataFrame, custom: Mapping[str, float], units: str) -> DataFrame:
    rows = [(n, float(v), units, "supplied", 3 + i) for i, (n, v) in enumerate(custom.items())]
    return df.sparkSession.createDataFrame(rows, "floor string, value double, units string, derived_from string, ord int")


def floors(df: DataFrame, label: str | None = None, by: Sequence[str] = (), custom: Mapping[str, float] | None = None, units: str = "rate") -> DataFrame:
    """floor, value, units and derived_from per group, with ``ord`` for ties; NULL is a label like others.

    Counts per label are summed again, so a group's labels never meet in one task.
    """
    if label is None and not custom:
        raise ValueError("floors need a label column, stated floors, or both")
    by = list(by)
    made = None
    if label is not None:
        n = df.groupBy(*by, label).agg(F.count("*").alias("n")).groupBy(*by)
        sums = n.agg(F.max("n").alias("top"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.count("*").alias("k"), F.sum("n").alias("N"))
        rows = F.array(
            *[F.struct(F.lit(f).alias("floor"), v.alias("value"), F.lit("rate").alias("units"), F.lit(d).alias("derived_from"), F.lit(i).alias("ord")) for i, (f, v, d) in enumerate((
                ("majority", F.col("top") / F.col("N"), "label marginal"), ("prior_matched", F.col("squares") / F.col("N") / F.col("N"), "label marginal"), ("uniform", 1 / F.col("k"), "class count")))]
        )
        made = sums.select(*by, F.inline(rows))
    if custom:
        stated = _stated(df, custom, units)
        if by:
            stated = df.select(*by).distinct().crossJoin(stated)
        made = stated if made is None else made.unionByName(stated)
    return made


def binding(made: DataFrame, by: Sequence[str] = (), higher_is_better: bool = True) -> DataFrame:
    """The strongest floor per group; floors on different scales are refused."""
    order = F.struct(F.col("value") if higher_is_better else -F.col("value"), -F.col("ord"))
    one = require(F.count_distinct("units") == 1, "floors span more than one scale", F.max_by(F.struct("floor", "value"), order))
    return made.groupBy(*by).agg(one.alias("b")).select(*by, F.col("b.floor").alias("binding_floor"), F.col("b.value").alias("floor_value"))


def binding_floor(df: DataFrame, by: Sequence[str], label: str | None, custom: Mapping[str, float] | None, higher_is_better: bool) -> DataFrame:
    return binding(floors(df, label, by, custom), by, higher_is_better)


def headroom(observed: float, made: DataFrame, higher_is_better: bool = True) -> DataFrame:
    """observed, binding floor, its value, the headroom and whether it is positive."""
    gap = F.lit(observed) - F.col("floor_value")
    out = binding(made, (), higher_is_better).withColumn("observed", F.lit(float(observed)))
    return out.withColumn("headroom", gap if higher_is_better else -gap).withColumn("above_floor", F.col("headroom") > 0)
