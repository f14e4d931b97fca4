"""Append-only JSON lines, logs and sinks as tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators.accounting import first_rows, latest_rows, row_status

BAD = "_corrupt_record"


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Records of JSON lines under a fixed schema; what cannot be read is kept in ``_corrupt_record``.

    Blank lines are none. A missing path is an error.
    """
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    whole = T.StructType([*fields, T.StructField(BAD, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    return lines.select(F.from_json("value", whole, options).alias("r")).select("r.*")


def count_bad(records: DataFrame) -> DataFrame:
    """One row: lines that could not be read."""
    return records.select(F.col(BAD).isNotNull().alias("b")).agg(F.count_if("b").alias("n_bad"))


def records(lines: DataFrame, key: str = "unit_id") -> DataFrame:
    """Readable lines that have a key."""
    return lines.where(F.col(BAD).isNull() & F.col(key).isNotNull()).drop(BAD)


def to_frame(lines: DataFrame, order: Sequence[str] = ("seq",), drop_errors: bool = False) -> DataFrame:
    """The tidy frame of a sink: the last row of each unit, its status derived, errors kept unless dropped."""
    rows = latest_rows(records(lines), "unit_id", order)
    status = F.col("status") if "status" in rows.columns else F.lit(None).cast("string")
    out = rows.withColumn("status", row_status(status, F.col("error")))
    return out.where("error IS NULL") if drop_errors else out


def read_manifest(spark: SparkSession, path: str, schema: T.StructType | str, order: Sequence[str] = ("plan_seq",)) -> DataFrame:
    """The plan, first record of each unit; an empty frame where nothing was written yet."""
    fields = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], fields)
    return first_rows(records(read_jsonl(spark, path, fields)), "unit_id", order)


def read_events(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """An event log whose ``t`` is text in ISO 8601; unreadable lines stay visible in ``_corrupt_record``."""
    return read_jsonl(spark, path, schema).withColumn("t", F.to_timestamp("t"))


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows; the committer makes files visible whole or not at all."""
    df.write.mode("append").json(path)


def append_plan(plan: DataFrame, path: str, existing: DataFrame) -> None:
    """Append the planned units that are not there yet; call before the first request."""
    plan.join(existing.select("unit_id"), "unit_id", "left_anti").write.mode("append").json(path)


def parse_log(lines: DataFrame, patterns: Mapping[str, str], column: str = "value") -> DataFrame:
    """Text lines by the first pattern that occurs in them: event and ``fields`` of its named groups.

    Blank lines go; a line that no pattern fits has a NULL event. Groups are written ``(?P<name>...)``.
    """
    line = F.col(column)
    event, fields = F.lit(None).cast("string"), F.lit(None).cast("map<string,string>")
    for name, pattern in reversed(list(patterns.items())):
        java = pattern.replace("(?P<", "(?<")
        groups = re.compile(pattern).groupindex
        pairs = [x for g, i in groups.items() for x in (F.lit(g), F.nullif(F.regexp_extract(line, java, i), F.lit("")))]
        event = F.when(line.rlike(java), name).otherwise(event)
        fields = F.when(line.rlike(java), F.create_map(*pairs) if pairs else F.lit(None).cast("map<string,string>")).otherwise(fields)
    return lines.where(F.trim(line) != "").select(line.alias("line"), event.alias("event"), fields.alias("fields"))


def unmatched(parsed: DataFrame) -> DataFrame:
    """One row: lines without an event and up to five of them, cut at 200."""
    rows = parsed.where("event IS NULL")
    n = rows.agg(F.count("*").alias("unmatched"))
    few = rows.select(F.left("line", F.lit(200)).alias("l")).orderBy("l").limit(5).agg(F.collect_list("l").alias("examples"))
    return n.crossJoin(few)


def typed(value: Column) -> Column:
    """A parsed group as DOUBLE where it is a number."""
    return value.try_cast("double")


def merge_shards(shards: Sequence[DataFrame]) -> DataFrame:
    """The union of shard frames with their number; a unit in two shards is refused."""
    if not shards:
        raise ValueError("there are no shards to merge")
    out = None
    for i, s in enumerate(shards):
        numbered = s.withColumn("shard", F.lit(i))
        out = numbered if out is None else out.unionByName(numbered, allowMissingColumns=True)
    twice = out.groupBy("unit_id").agg(F.count_distinct("shard").alias("n")).where("n > 1").limit(1)
    if not twice.isEmpty():
        raise ValueError(f"unit {twice.first()['unit_id']} is in two shards")
    return out


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def content_mark(lines: DataFrame) -> DataFrame:
    """One row: number of lines and two sums of their hashes, whatever their order."""
    h = lambda *x: F.coalesce(F.sum(F.xxhash64("value", *x).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    return lines.agg(F.count("*").alias("n"), h().alias("s"), h(F.lit(1)).alias("u"))


def combine_shards(spark: SparkSession, path: str, n: int, schema: T.StructType | str, order: Sequence[str] = ("seq",)) -> str:
    """Write the lines of n shards of ``path`` as one sink there, and the first record of each planned unit beside it.

    A marker beside the sink holds its content mark. What is no earlier merge, or has changed since,
    is not overwritten; units in two shards are refused, shards that are not there are not.
    """
    mark = companion(path, "merged")
    if _exists(spark, path):
        if not _exists(spark, mark):
            raise FileExistsError(f"{path} was not made by a merge and is left as it is")
        if content_mark(spark.read.text(path)).first() != spark.read.schema("n bigint, s decimal(38,0), u decimal(38,0)").json(mark).first():
            raise FileExistsError(f"{path} has changed since its merge and is left as it is")
    there = [p for p in (shard_path(path, i, n) for i in range(n)) if _exists(spark, p)]
    if not there:
        raise FileNotFoundError(f"{path} has none of {n} shards")
    merge_shards([to_frame(read_jsonl(spark, p, schema), order) for p in there])
    spark.read.text(there).write.mode("overwrite").text(path)
    plans = [p for p in (companion(s, "manifest") for s in there) if _exists(spark, p)]
    if plans:
        lines = spark.read.text(plans).withColumn("unit_id", F.get_json_object("value", "$.unit_id")).withColumn("_at", F.monotonically_increasing_id())
        first_rows(lines, "unit_id", ("_at",)).select("value").write.mode("overwrite").text(companion(path, "manifest"))
    content_mark(spark.read.text(path)).write.mode("overwrite").json(mark)
    return path


def shard_path(path: str, index: int, n: int) -> str:
    """``run.jsonl`` becomes ``run.shard-003-of-016.jsonl``; the index is padded to the width of n."""
    if not 0 <= index < n:
        raise ValueError(f"shard {index} is none of {n}")
    stem, dot, suffix = path.rpartition(".")
    width = len(str(n))
    return f"{stem if dot else path}.shard-{index:0{width}d}-of-{n}{dot}{suffix if dot else ''}"


def companion(path: str, kind: str) -> str:
    """The manifest, events or marker file beside a sink; the whole name is kept, so none clash."""
    return f"{path}.{kind}"
