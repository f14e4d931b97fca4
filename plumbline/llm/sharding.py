"""Sharding by histogram sort, with DataFrame functions only.

Rows are ordered by a key of three integers: a hash of the text, a hash of the id, and a hash of the
row's number. Shard limits are keys at which the bytes below reach equal shares. They are found by
rounds of probing: a round counts exact bytes per candidate interval, in partial sums per partition;
only intervals in which a limit lies are cut into finer candidates. An interval that holds a single
value of a key component is cut by the next component, so equal texts stay together unless a limit
has to fall among them. Rounds end when each limit is within the tolerance or no finer key exists.
Then rows move once.

The driver sees at most ``2 ** bits`` counts for each limit that is still open.

Defined results: a null text has no bytes and the checksum of the empty text; null ids and repeated
rows are rows of their own; an empty table gives no rows; extra columns travel along in
:func:`shard_documents`, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import any_names, let, only, written

OVERHEAD = 16
PARTS = ("k0", "k1", "k2")
LOW, HIGH = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Limit:
    """Rows whose key is at least ``key`` lie beyond this limit."""

    key: tuple[int, int, int]

    def beyond(self) -> Column:
        a, b, c = (F.col(p) for p in PARTS)
        x, y, z = (F.lit(v).cast("bigint") for v in self.key)
        return (a > x) | ((a == x) & ((b > y) | ((b == y) & (c >= z))))


@dataclass
class _Open:
    """Where a limit is sought: bytes wanted below it, and the interval of one key component."""

    shard: int
    want: int
    fixed: tuple[int, ...]
    low: int
    high: int
    below: int


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with size and key; the row number is unique within a scan."""
    number = F.monotonically_increasing_id()
    return docs.select(
        "*",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"),
        F.xxhash64("text").alias("k0"),
        F.xxhash64("doc_id").alias("k1"),
        F.xxhash64(number).alias("k2"),
    )


def _whole(head: tuple[int, ...], rest: int) -> tuple[int, int, int]:
    return (*head, *(rest,) * (3 - len(head)))


def _round(slim: DataFrame, spots: list[tuple[tuple[int, ...], int, int]], bits: int) -> dict:
    """Exact bytes per candidate interval of each spot (fixed components, low, high).

    Spots are apart from each other, so a row finds its own by binary search; its candidate follows
    from the spot's numbers.
    """
    spots = sorted(spots, key=lambda x: _whole((*x[0], x[1]), LOW))
    starts = [Limit(_whole((*fixed, low), LOW)) for fixed, low, _ in spots]
    ends = [_whole((*fixed, high), HIGH) for fixed, _, high in spots]
    widths = [max(1, -(-(high - low + 1) >> bits)) for _, low, high in spots]
    wide = "decimal(20,0)"  # unsigned distances of 64 bits are exact in it

    def hit(spot: Column) -> Column:
        """The row's spot, bound once, with its candidate and key component; NULL outside all spots."""
        of_spot = lambda values, kind="bigint": F.get(F.array(*[F.lit(v).cast(kind) for v in values]), spot)
        a, b, c = (F.col(p) for p in PARTS)
        x, y, z = (of_spot([e[i] for e in ends]) for i in range(3))
        inside = (a < x) | ((a == x) & ((b < y) | ((b == y) & (c <= z))))
        level = of_spot([len(fixed) for fixed, _, _ in spots])
        value = F.when(level == 0, a).when(level == 1, b).otherwise(c)
        cell = F.floor((value.cast(wide) - of_spot([low for _, low, _ in spots]).cast(wide)) / of_spot(widths, wide)).cast("int")
        return F.when((spot >= 0) & inside, F.struct(spot.alias("spot"), cell.alias("cell"), value.alias("value")))

    counted = (
        slim.select("size", let(_shard(starts, 0, len(starts)) - 1, hit).alias("hit")).where("hit IS NOT NULL").select("size", "hit.*")
        .groupBy("spot", "cell").agg(F.sum("size").alias("bytes"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    )
    found: dict[int, list] = {}
    for r in counted.collect():
        found.setdefault(r["spot"], []).append((r["lo"], r["hi"], r["bytes"]))
    return {spots[i]: sorted(v) for i, v in found.items()}


def find_limits(slim: DataFrame, total: int, shards: int, tolerance: float, bits: int = 10) -> list[Limit]:
    """The limits between shards; each ends within ``tolerance`` of a shard's bytes if a key allows."""
    most = tolerance * total / shards
    open_ = [_Open(s, round(total * s / shards), (), LOW, HIGH, 0) for s in range(1, shards)]
    done: dict[int, Limit] = {}
    while open_:
        cells = _round(slim, list({(o.fixed, o.low, o.high): None for o in open_}), bits)
        left = []
        for o in open_:
            below, pad = o.below, (LOW,) * (2 - len(o.fixed))
            options: list[tuple[int, Limit]] = []
            inner = None
            for lo, hi, size in cells.get((o.fixed, o.low, o.high), []):
                options.append((abs(below - o.want), Limit((*o.fixed, lo, *pad))))
                if below <= o.want < below + size:
                    inner = (lo, hi, below)
                below += size
            last = cells[(o.fixed, o.low, o.high)][-1][1]
            if last < HIGH:
                options.append((abs(below - o.want), Limit((*o.fixed, last + 1, *pad))))
            error, best = min(options, key=lambda x: (x[0], x[1].key))
            if error <= most or inner is None:
                done[o.shard] = best
            elif inner[0] < inner[1]:
                left.append(_Open(o.shard, o.want, o.fixed, inner[0], inner[1], inner[2]))
            elif len(o.fixed) < 2:
                left.append(_Open(o.shard, o.want, (*o.fixed, inner[0]), LOW, HIGH, inner[2]))
            else:
                done[o.shard] = best
        open_ = left
    keys = [done[s].key for s in range(1, shards)]
    return [Limit(max(keys[: i + 1])) for i in range(len(keys))]


def _shard(limits: list[Limit], low: int, high: int) -> Column:
    """The number of limits at or below the key, by binary search unrolled into CASE."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(limits[middle].beyond(), _shard(limits, middle + 1, high)).otherwise(_shard(limits, low, middle))


def assign_shards(docs: DataFrame, shards: int, tolerance: float = 0.005, rows_per_group: int = 100_000) -> DataFrame:
    """``doc_id``, size, text checksum, shard and slot of every row.

    Slots number the rows of a shard without gaps: rows are spread over groups by the hash of their
    number, groups get the counts before them, and only a group is ordered in one task.
    """
    slim = written(keyed(only(docs, "doc_id", "text")).select("doc_id", "size", F.coalesce(F.crc32("text"), F.lit(0)).cast("bigint").alias("text_crc32"), *PARTS), "shard-keys")
    total = slim.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    limits = find_limits(slim, total["bytes"], shards, tolerance) if total["rows"] else []
    groups = max(1, -(-total["rows"] // (shards * rows_per_group)))
    placed = slim.withColumn("shard", _shard(limits, 0, len(limits)).cast("int")).withColumn("part", F.pmod("k2", F.lit(groups)))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy(*PARTS)) - 1
    if groups == 1:
        return placed.select("doc_id", "size", "text_crc32", "shard", rank.cast("bigint").alias("slot"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.groupBy("shard", "part").count().select("shard", "part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    return placed.withColumn("rank", rank).join(base, ["shard", "part"]).select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank")).cast("bigint").alias("slot"))


@any_names
def shard_documents(docs: DataFrame, shards: int, tolerance: float = 0.005) -> DataFrame:
    """All columns of ``docs`` and their shard, moved once: partition i holds shard i, in key order.

    Rows are written with their keys first, so that limits and the move see the same row numbers.
    """
    full = written(keyed(docs), "shard-rows")
    total = full.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()["bytes"]
    limits = find_limits(full.select("size", *PARTS), total, shards, tolerance) if total else []
    placed = full.withColumn("shard", _shard(limits, 0, len(limits)).cast("int"))
    return placed.repartitionById(shards, "shard").sortWithinPartitions(*PARTS).drop("size", *PARTS)
