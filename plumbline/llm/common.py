"""What the training-data operators share: the shared folder and Arrow helpers."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Where that setting is absent, as in tests on one machine, a temporary folder is made; on a cluster
    this is refused, as executors would not see each other's files there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
        whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
        return whole.replace("file:/", "file:///", 1) if re.match("file:/[^/]", whole) else whole
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, _own["dir"], True)
    return "file://" + _own["dir"]


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder once and read it back.

    This cuts the lineage: a lost executor costs the tasks it ran and not the whole history.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Bind ``value`` to a lambda variable so that it is evaluated once per row."""
    return F.transform(F.array(value), body)[0]


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, each the first of exactly that name, else the first in another letter case."""
    names = df.columns
    folded = [n.lower() for n in names]
    at = [names.index(c) if c in names else folded.index(c.lower()) for c in columns]
    numbered = df.toDF(*[f"c{i}" for i in range(len(names))])
    return numbered.select(*[F.col(f"c{i}").alias(c) for i, c in zip(at, columns)])


def any_names(f):
    """Run ``f(docs, ...)`` under names that cannot clash; the result has its columns' own names again.

    doc_id, text and n_chars keep their names, all other columns get numbers; columns that ``f`` adds
    come last and keep theirs.
    """

    @functools.wraps(f)
    def wrapped(docs: DataFrame, *args, **kwargs) -> DataFrame:
        names = docs.columns
        own = [n if n in ("doc_id", "text", "n_chars") and names.index(n) == i else f"_x{i}" for i, n in enumerate(names)]
        out = f(docs.toDF(*own), *args, **kwargs)
        return out.toDF(*names, *out.columns[len(names) :])

    return wrapped


def raw_texts(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def sliced(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a piece holds at most ``limit`` bytes of ``column``, one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0)
        total = np.cumsum(np.asarray(sizes, dtype=np.int64))
        at = 0
        while at < len(total):
            base = total[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(total, base + limit, "right")))
            yield batch.slice(at, end - at)
            at = end


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser over unsigned 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def join_spread(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows with the one row of their key where single keys may hold most rows.

    ``right`` is unique by ``key`` and its column ``n`` counts the rows of ``left`` that have the key.
    Keys with more than a thousandth of all rows, fewer than a thousand by their definition, are
    broadcast and their rows stay where they are; all other rows meet in a shuffle. ``n`` is dropped.
    """
    hot = right.where(F.col("n") * 1000 > total).drop("n")
    cold = right.where(F.col("n") * 1000 <= total).drop("n")
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how)
    return left.join(F.broadcast(hot), key).unionByName(rest)
