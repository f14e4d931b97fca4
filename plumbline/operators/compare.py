"""Comparing two tables within a tolerance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mismatches(left: DataFrame, right: DataFrame, keys: Sequence[str], rtol: float = 1e-12, atol: float = 0.0) -> DataFrame:
    """keys, column, left and right of all values that differ, rows that only one side has included.

    Numbers agree within atol + rtol * |right|; NULL agrees with NULL and NaN with NaN.
    """
    values = [c for c in left.columns if c not in keys]
    if set(left.columns) != set(right.columns):
        raise ValueError(f"columns differ: {sorted(set(left.columns) ^ set(right.columns))}")
    a = left.select(*[F.col(k).alias(f"_a{i}") for i, k in enumerate(keys)], F.struct(*values).alias("l"))
    b = right.select(*[F.col(k).alias(f"_b{i}") for i, k in enumerate(keys)], F.struct(*values).alias("r"))
    test = F.lit(True)
    for i in range(len(keys)):
        test &= F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))
    both = a.join(b, test, "full")
    checks = []
    for c in values:
        x, y = F.col(f"l.{c}"), F.col(f"r.{c}")
        if left.schema[c].dataType.typeName() in ("double", "float"):
            same = x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= atol + rtol * F.abs(y), F.lit(False))
        else:
            same = x.eqNullSafe(y)
        wrong = ~same | F.col("l").isNull() | F.col("r").isNull()
        checks.append(F.when(wrong, F.struct(F.lit(c).alias("column"), x.cast("string").alias("left"), y.cast("string").alias("right"))))
    named = [F.coalesce(f"_a{i}", f"_b{i}").alias(k) for i, k in enumerate(keys)]
    return both.select(*named, F.inline(F.array_compact(F.array(*checks))))


def assert_same(left: DataFrame, right: DataFrame, keys: Sequence[str], rtol: float = 1e-12, atol: float = 0.0) -> None:
    wrong = mismatches(left, right, keys, rtol, atol).limit(5).collect()
    if wrong:
        raise AssertionError("\n".join(map(str, wrong)))
