"""Task items: canonical and foreign records, checked before use."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import json_path

FIELDS = ("id", "cluster", "group", "messages", "prompt", "grader", "gold", "gold_docs", "meta", "target")
CONTAINERS = ("items", "data", "examples", "tasks")


class TaskFormatError(ValueError):
    """Records that are no task items."""


def raw_records(spark: SparkSession, path: str) -> DataFrame:
    """One JSON text per record: a line of .jsonl, or an element of a list or of a known container."""
    if path.endswith(".jsonl"):
        return spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias("record"))
    whole = spark.read.text(path, wholetext=True)
    text = F.col("value")
    inside = F.coalesce(*[F.get_json_object(text, f"$.{c}") for c in CONTAINERS])
    listed = F.when(F.trim(text).startswith("["), text).otherwise(inside)
    return whole.select(F.explode(F.from_json(listed, "array<string>")).alias("record"))


def map_records(records: DataFrame, mapping: Mapping[str, str | Column]) -> DataFrame:
    """Foreign records to canonical fields by dotted paths or expressions over ``record``."""
    unknown = set(mapping) - set(FIELDS)
    if unknown:
        raise TaskFormatError(f"no fields {sorted(unknown)}")
    value = lambda m: json_path(F.col("record"), m) if isinstance(m, str) else m
    return records.select(*[(value(mapping[f]) if f in mapping else F.lit(None).cast("string")).alias(f) for f in FIELDS])


def load_tasks(spark: SparkSession, path: str, mapping: Mapping[str, str | Column] | None = None) -> DataFrame:
    """Checked items of a file; every fault is an error that names it."""
    raw = raw_records(spark, path)
    if mapping is None:
        known = F.array(*[F.lit(f) for f in FIELDS])
        odd = raw.select(F.array_except(F.json_object_keys("record"), known).alias("odd")).where("size(odd) > 0").limit(1)
        if not odd.isEmpty():
            raise TaskFormatError(f"unknown fields {odd.first()['odd']}")
    items = map_records(raw, mapping or {f: f for f in FIELDS})
    bad = faults(items).limit(1)
    if not bad.isEmpty():
        raise TaskFormatError(f"{bad.first()['id']}: {bad.first()['fault']}")
    return items


def faults(items: DataFrame) -> DataFrame:
    """id and fault of each item that cannot be used; no rows for a sound set."""
    c = F.col
    fault = (
        F.when(c("id").isNull() | (c("id") == ""), "no id")
        .when(c("prompt").isNotNull() == c("messages").isNotNull(), "exactly one of prompt and messages is needed")
        .when(c("grader").isNotNull() & c("gold").isNull() & ~c("grader").contains("abstain"), "a grader without gold")
        .when(c("gold_docs").isNotNull() & ~F.trim("gold_docs").rlike(r"^[\[{]"), "gold_docs is a list or a mapping")
    )
    own = items.select("id", fault.alias("fault")).where("fault IS NOT NULL")
    twice = items.groupBy("id").count().where("count > 1").select("id", F.lit("the id is there twice").alias("fault"))
    return own.union(twice)


def save_tasks(items: DataFrame, path: str) -> None:
    """JSON lines without absent keys, the inverse of :func:`load_tasks`."""
    items.select(F.to_json(F.struct(*[c for c in FIELDS if c in items.columns]), {"ignoreNullFields": "true"}).alias("value")).write.mode("overwrite").text(path)


def load_corpus(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and text of JSON lines with exactly ``id`` and ``text``; ids are unique."""
    raw = spark.read.text(path).where(F.trim("value") != "")
    docs = raw.select(F.get_json_object("value", "$.id").alias("doc_id"), F.get_json_object("value", "$.text").alias("text"), F.array_sort(F.json_object_keys("value")).alias("k"))
    odd = docs.where(F.coalesce(F.to_json("k") != '["id","text"]', F.lit(True))).limit(1)
    if not odd.isEmpty():
        raise TaskFormatError(f"a document has the keys {odd.first()['k']}")
    twice = docs.groupBy("doc_id").count().where("count > 1").limit(1)
    if not twice.isEmpty():
        raise TaskFormatError(f"document {twice.first()['doc_id']} is there twice")
    return docs.select("doc_id", "text")
