"""The event log and the sink while they grow, by Structured Streaming.

Late events are an addition of ours: with event-time windows the watermark drops what comes more
than ``delay`` behind. States and counters that have no window take all rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from plumbline.operators.accounting import latest_rows
from plumbline.sources.tables import shared_folder


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder, or one file, as a stream; new ones are read as they come."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def per_minute(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Units per minute of event time."""
    w = F.window("t", "1 minute")
    return events.withWatermark("t", delay).groupBy(w).agg(F.count("*").alias("n")).select(F.col("window.start").alias("minute"), "n")


def sessions(events: DataFrame, stall: str = "300 seconds", delay: str = "10 minutes", by: str | None = None) -> DataFrame:
    """Stretches of activity; a gap of more than ``stall`` parts two of them."""
    keys = [by] if by else []
    marked = events.withWatermark("t", delay).withColumn("_all", F.lit(1))  # sessions need a key
    out = marked.groupBy(*(keys or ["_all"]), F.session_window("t", stall)).agg(F.count("*").alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))
    return out.select(*keys, "first", "last", "n")


def run_ends(events: DataFrame, silence: str = "10 minutes", delay: str = "10 minutes", key: str = "run_id") -> DataFrame:
    """One row per run of a growing log: ``ended`` when its end was seen, or ``killed`` when it has been silent.

    ``events`` has ``t``, ``event`` and the run's key. A run's state is its first and last moment and its
    number of units; event time past the last event by ``silence`` closes it.
    """
    kind = events.schema[key].dataType.simpleString()
    result = f"`{key}` {kind}, outcome string, started timestamp, last_event timestamp, units bigint"
    wait = int(pd.Timedelta(silence).total_seconds() * 1000)

    def step(own: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, units, ended = state.getOption or (None, None, 0, False)
        for pdf in frames:
            if pdf.empty:  # the call that a timeout makes
                continue
            low, high = int(pdf["t"].min().value // 1000), int(pdf["t"].max().value // 1000)
            first, last = min(low, first if first is not None else low), max(high, last if last is not None else high)
            units += int((pdf["event"] == "unit").sum())
            ended |= bool((pdf["event"] == "run_end").any())
        if ended or state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [own[0]], "outcome": ["ended" if ended else "killed"], "started": [pd.Timestamp(first, unit="us")], "last_event": [pd.Timestamp(last, unit="us")], "units": [units]})
        else:
            state.update((first, last, units, ended))
            state.setTimeoutTimestamp(max(last // 1000 + wait, state.getCurrentWatermarkMs() + 1))

    rows = events.withWatermark("t", delay).select(key, "t", "event").groupBy(key)
    return rows.applyInPandasWithState(step, result, "first bigint, last bigint, units bigint, ended boolean", "append", "EventTimeTimeout")


def counts(events: DataFrame, key: str) -> DataFrame:
    """Running counts of a column's values."""
    return events.groupBy(key).agg(F.count("*").alias("n"))


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key so far, by ``order``: the state is one row per key, and late rows cannot win."""
    rest = [c for c in rows.columns if c != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("row"))
    return best.select(key, "row.*")


def upsert_into(path: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the folder holds one version per batch, the latest rows so far in each.

    A batch that is run again writes the same version again.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        merged = batch if epoch == 0 else batch.unionByName(spark.read.parquet(f"{path}/v={epoch - 1}"))
        latest_rows(merged, key, (order,)).write.mode("overwrite").parquet(f"{path}/v={epoch}")

    return write


def drain(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Run a stream over what is there and return the result table.

    Each batch is written to the shared folder under its number: the whole result in ``complete`` mode,
    new rows in ``append`` mode; the driver holds none of it.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/stream-{name}-{uuid.uuid4().hex}"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/_batch={epoch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if not query.recentProgress:
        return spark.createDataFrame([], stream.schema)
    found = spark.read.option("basePath", f"{folder}/rows").parquet(f"{folder}/rows/_batch=*")
    if mode == "complete":
        found = found.where(F.col("_batch") == found.agg(F.max("_batch")).first()[0])
    return found.select(*stream.columns)
