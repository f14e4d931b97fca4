"""Arrays beside a sink: a table of content-addressed arrays, joined on demand."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "request_key string, name string, dtype string, shape array<bigint>, data binary"


def split_arrays(meta: Mapping[str, Any]) -> tuple[dict[str, Any], dict[str, np.ndarray]]:
    """What of ``meta`` is plain, its scalars as Python's own, and its arrays of one dimension or more."""
    arrays = {k: np.asarray(v) for k, v in meta.items() if getattr(v, "ndim", 0)}
    return {k: _plain(v) for k, v in meta.items() if k not in arrays}, arrays


def _plain(value: Any) -> Any:
    if isinstance(value, Mapping):
        return {str(k): _plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [_plain(v) for v in value]
    if getattr(value, "ndim", 0):
        return value.tolist()
    return value.item() if hasattr(value, "item") else value


def array_rows(key: str, arrays: Mapping[str, np.ndarray]) -> list[tuple]:
    """Rows of the table for the arrays of one request."""
    return [(key, name, a.dtype.str, list(a.shape), np.ascontiguousarray(a).tobytes()) for name, a in arrays.items()]


class ArrayStore:
    """A folder of arrays; writing a request again adds equal rows, and one of them is read."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def put(self, arrays: DataFrame | Iterable[tuple]) -> None:
        """Append rows of ``SCHEMA``, made by tasks or by :func:`array_rows`."""
        df = arrays if isinstance(arrays, DataFrame) else self.spark.createDataFrame(list(arrays), SCHEMA)
        df.withColumn("head", F.left("request_key", F.lit(2))).write.mode("append").partitionBy("head").parquet(self.folder)

    def of(self, rows: DataFrame) -> DataFrame:
        """The arrays of the rows' request keys, each once; a row without any is refused by :func:`load_arrays`."""
        stored = self.spark.read.parquet(self.folder)
        keys = rows.select("request_key").distinct().withColumn("head", F.left("request_key", F.lit(2)))
        return stored.join(keys, ["head", "request_key"], "left_semi").drop("head").dropDuplicates(["request_key", "name"])


def load_arrays(store: ArrayStore, key: str) -> dict[str, np.ndarray]:
    """The arrays of one request."""
    rows = store.of(store.spark.createDataFrame([(key,)], "request_key string")).collect()
    if not rows:
        raise FileNotFoundError(f"there are no arrays of {key}")
    return {r["name"]: np.frombuffer(r["data"], r["dtype"]).reshape(r["shape"]) for r in rows}
