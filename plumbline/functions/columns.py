"""Column helpers shared by the operators."""

from __future__ import annotations

import functools
import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(name: str) -> Column:
    """A numeric column as DOUBLE with NaN read as NULL, the one mark of a missing value."""
    x = F.col(name).cast("double")
    return F.when(~F.isnan(x), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero or NULL."""
    return F.when(b != 0, a.cast("double") / b)


def require(test: Column, message: str, value: Column) -> Column:
    """``value``, or an error where ``test`` does not hold; no job of its own."""
    return F.when(test, value).otherwise(F.raise_error(F.lit(message)))


def same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality of the key columns: NULL is a legal group."""
    test = F.lit(True)
    for k in keys:
        test &= left[k].eqNullSafe(right[k])
    return test


def join_groups(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys null-safely and keep one copy of them, the left one."""
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in right.columns if c not in keys])
    test = F.lit(True)
    for k in keys:
        test &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(renamed, test, how).drop(*[f"__{k}" for k in keys])


def own_group_names(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Run ``f(df, ..., by=...)`` on copies of the group columns, so that their names clash with no other."""
    signature = inspect.signature(f)

    @functools.wraps(f)
    def wrapped(*args, **kwargs) -> DataFrame:
        call = signature.bind(*args, **kwargs)
        call.apply_defaults()
        by = list(call.arguments["by"])
        own = [f"_by{i}" for i in range(len(by))]
        if not by or by == own:
            return f(*args, **kwargs)
        call.arguments["df"] = call.arguments["df"].withColumns({n: F.col(b) for n, b in zip(own, by)})
        call.arguments["by"] = own
        out = f(*call.args, **call.kwargs)
        return out.select(*[F.col(n).alias(b) for n, b in zip(own, by)], *[F.col(f"`{c}`") for c in out.columns if c not in own])

    return wrapped
