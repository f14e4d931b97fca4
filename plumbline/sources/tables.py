"""Tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where it is unset on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(named)
        whole = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
        return whole.replace("file:/", "file:///", 1) if re.match("file:/[^/]", whole) else whole
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if "at" not in _own:
        _own["at"] = tempfile.mkdtemp(prefix="plumbline-")
        atexit.register(shutil.rmtree, _own["at"], True)
    return f"file://{_own['at']}"


def saved(df: DataFrame, name: str = "step") -> DataFrame:
    """Write once and read back, which cuts the lineage and survives lost executors."""
    return read_back(df, saved_path(df, name))


def read_back(df: DataFrame, path: str) -> DataFrame:
    """The table that ``df`` was written to."""
    return df.sparkSession.read.schema(df.schema).parquet(path)


def saved_path(df: DataFrame, name: str = "step") -> str:
    """Write once; the folder's address, for tasks that read it themselves."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def read_saved(path: str, columns: Sequence[str] | None = None) -> pa.Table:
    """A small written table, for tasks that hold it whole."""
    return pa.concat_tables(saved_parts(path, columns))


def saved_parts(path: str, columns: Sequence[str] | None = None, where: list[tuple] | None = None) -> Iterator[pa.Table]:
    """The files of a written table in order, and of each the rows that ``where`` keeps."""
    system, folder = fs.FileSystem.from_uri(path)
    for at in sorted(x.path for x in system.get_file_info(fs.FileSelector(folder)) if x.path.endswith(".parquet")):
        with system.open_input_file(at) as f:
            yield pq.read_table(f, columns=list(columns) if columns else None, filters=where)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches put together until they have ``rows`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held).combine_chunks()
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all tasks, where a table is no larger than a few pieces a core.

    A file's row group is read by one task, into however many splits the file is cut; a table of many
    pieces stays as it is.
    """
    return df.repartition(key) if df.rdd.getNumPartitions() <= 3 * df.sparkSession.sparkContext.defaultParallelism else df
