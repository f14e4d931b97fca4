"""Cluster-aware statistics: the unit that is resampled is the cluster and never the row.

All operators reduce rows to clusters in the JVM first. What is random or needs a normal quantile is
finished by numpy over one number per cluster. ``engine="exact"`` draws what a single generator over
sorted clusters draws, cell by cell, and where a cell is large in pieces of the generator's stream over
all tasks; ``engine="poisson"`` draws independent Poisson weights by hash, partition by partition, for
cells whose clusters should not meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from plumbline.functions.columns import join_groups, number, own_group_names, ratio, require
from plumbline.functions.md5 import Messages
from plumbline.sources.tables import gathered, saved, saved_path, saved_parts

NORMAL = NormalDist()
METHODS = ("bca", "percentile")
COVERAGE = {3: 73, 5: 84, 10: 90, 20: 92, 30: 94}
FEW, EXCLUDED = 20, 0.10
DRAW_CELLS = 1 << 24
#: Drawn numbers of a group that one task draws; those of a larger group are drawn in pieces over all tasks.
ALONE = 1 << 28
#: Drawn numbers of a piece, of a stretch whose refused numbers are counted, and of a step.
PIECE, STRETCH, STEP = 1 << 26, 1 << 22, 1 << 14
DRAWS, ALPHA = 10_000, 0.05


# == clusters ==


def clusters(df: DataFrame, value: str, by: Sequence[str] = (), cluster: str = "cluster") -> DataFrame:
    """Per group and cluster: m rows with a value, their mean and sum of squared deviations.

    A value without a cluster label is refused: it could be counted nowhere.
    """
    v = number(value)
    label = require(F.col(cluster).isNotNull() | v.isNull(), f"a row carries {value} and no {cluster}", F.col(cluster))
    rows = df.select(*by, label.alias("cluster"), v.alias("v")).where("v IS NOT NULL")
    return rows.groupBy(*by, "cluster").agg(F.count("*").alias("m"), F.avg("v").alias("mean"), (F.var_pop("v") * F.count("*")).alias("ss"))


@own_group_names
def cluster_mean(df: DataFrame, value: str, by: Sequence[str] = (), cluster: str = "cluster") -> DataFrame:
    """The unweighted mean of cluster means, with counts of clusters, rows and rows without a value."""
    return _cluster_mean(clusters(df, value, by, cluster), df, value, by)


def _cluster_mean(per: DataFrame, df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    point = per.groupBy(*by).agg(F.avg("mean").alias("point"), F.count("*").alias("n_clusters"), F.sum("m").alias("n_rows"))
    lost = df.select(*by, number(value).alias("v")).groupBy(*by).agg(F.count_if(F.col("v").isNull()).alias("n_excluded"))
    if not by:
        return point.crossJoin(lost)
    return join_groups(lost, point, by, "left").select(*by, "point", F.coalesce("n_clusters", F.lit(0)).alias("n_clusters"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), "n_excluded")


@own_group_names
def icc1(df: DataFrame, value: str, by: Sequence[str] = (), cluster: str = "cluster") -> DataFrame:
    """One-way random-effects intraclass correlation of unbalanced clusters, clipped at 0."""
    return _icc(clusters(df, value, by, cluster), by)


def _icc(per: DataFrame, by: Sequence[str]) -> DataFrame:
    grand = per.groupBy(*by).agg(
        F.count("*").alias("k"), F.sum("m").alias("N"), F.sum(F.col("m") * F.col("m")).cast("double").alias("m2"),
        (F.sum(F.col("m") * F.col("mean")) / F.sum("m")).alias("grand"), F.sum("ss").alias("ss_w"),
    )
    joined = join_groups(per.select(*by, "m", "mean"), grand.select(*by, "grand"), by) if by else per.crossJoin(grand.select("grand"))
    between = joined.groupBy(*by).agg(F.sum(F.col("m") * (F.col("mean") - F.col("grand")) * (F.col("mean") - F.col("grand"))).alias("ss_b"))
    out = join_groups(grand, between, by) if by else grand.crossJoin(between)
    fit = (F.col("k") >= 2) & (F.col("N") > F.col("k"))
    c = F.col
    out = out.select(
        *by, "k", "N", F.when(fit, (c("N") - c("m2") / c("N")) / (c("k") - 1)).alias("m0"),
        F.when(fit, c("ss_b") / (c("k") - 1)).alias("ms_between"), F.when(fit, c("ss_w") / F.nullif(c("N") - c("k"), F.lit(0))).alias("ms_within"),
    )
    s2 = F.when(c("m0") > 0, (c("ms_between") - c("ms_within")) / c("m0")).otherwise(0.0)
    rho = F.when(c("m0").isNull(), None).when((s2 <= 0) | (s2 + c("ms_within") <= 0), 0.0).otherwise(s2 / (s2 + c("ms_within")))
    return out.withColumn("rho", rho)


@own_group_names
def effective_n(df: DataFrame, value: str, by: Sequence[str] = (), cluster: str = "cluster") -> DataFrame:
    """Design effect and effective sample size; 1 and N where no cluster has two rows."""
    return _effective(_icc(clusters(df, value, by, cluster), by))


def _effective(icc: DataFrame) -> DataFrame:
    c = F.col
    alone = c("N") == c("k")
    deff = F.when(alone, 1.0).otherwise(1 + (c("m0") - 1) * c("rho"))
    return icc.withColumn("rho", F.when(~alone, c("rho"))).withColumn("deff", deff).withColumn("n_eff", c("N") / deff)


# == resampling ==


def tails(alpha: float) -> tuple[float, float]:
    return alpha / 2, 1 - alpha / 2


def bca_bounds(estimate: float, draws: np.ndarray, left_out: np.ndarray, alpha: float) -> tuple[float, float]:
    """Bias-corrected and accelerated bounds; replicates equal to the estimate count half."""
    d = left_out.mean() - left_out
    return _bca(estimate, draws, np.sum(d * d), np.sum(d * d * d), alpha)


def _bca(estimate: float, draws: np.ndarray, squares: float, cubes: float, alpha: float) -> tuple[float, float]:
    """:func:`bca_bounds` from sums of powers of what the leave-one-out means are below their mean."""
    n, near = draws.size, 1e-12 * (max(1.0, abs(estimate)) + abs(estimate))
    gap = draws - estimate
    equal = np.count_nonzero(np.abs(gap) <= near)
    share = (np.count_nonzero(gap < -near) + equal / 2) / n
    bias, spread = NORMAL.inv_cdf(float(np.clip(share, 0.5 / n, 1 - 0.5 / n))), 6.0 * squares**1.5
    skew = float(cubes) / spread if spread else 0.0
    shifted = [bias + NORMAL.inv_cdf(q) for q in tails(alpha)]
    lo, hi = np.quantile(draws, [NORMAL.cdf(bias + s / (1 - skew * s)) for s in shifted])
    return float(lo), float(hi)


def mean_replicates(x: np.ndarray, n_boot: int, seed: int):
    """Mean, bootstrap means and leave-one-out means of one value per cluster, in chunks of draws."""
    k, rng = x.size, np.random.default_rng(seed)
    step = max(1, DRAW_CELLS // k)
    reps = np.concatenate([x[rng.integers(0, k, size=(min(step, n_boot - i), k))].mean(axis=1) for i in range(0, n_boot, step)])
    return float(x.mean()), reps, (x.sum() - x) / (k - 1)


def interval(estimate: float, draws: np.ndarray, left_out: np.ndarray, alpha: float, method: str) -> dict[str, float]:
    return _found(estimate, draws, bca_bounds(estimate, draws, left_out, alpha) if method == "bca" else None, alpha)


def _found(estimate: float, draws: np.ndarray, bounds: tuple[float, float] | None, alpha: float) -> dict[str, float]:
    lo, hi = bounds or map(float, np.quantile(draws, tails(alpha)))
    return {"point": estimate, "lo": lo, "hi": hi, "se": float(draws.std(ddof=1))}


def _check(method: str, engine: str = "exact") -> None:
    if method not in METHODS or engine not in ("exact", "poisson"):
        raise ValueError(f"method is one of {METHODS}, engine exact or poisson; not {method!r}, {engine!r}")


def _by_group(per: DataFrame, by: Sequence[str], run: Callable[[pd.DataFrame], dict], schema: str) -> DataFrame:
    """Apply ``run`` to the clusters of each group, sorted by label."""
    types = {f.name: f.dataType.simpleString() for f in per.schema}
    head = ", ".join(f"`{b}` {types[b]}" for b in by)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(pdf.sort_values("cluster", kind="stable"))
        keys = {b: pdf[b].iloc[0] for b in by}
        return pd.DataFrame([{**keys, **out}])

    keyed = per if by else per.withColumn("_all", F.lit(1))
    return keyed.groupBy(*(by or ["_all"])).applyInPandas(one, f"{head}, {schema}" if by else schema)


# == one generator's draws over all tasks ==


def _pairwise(part: Callable[[int, int], float], lo: int, n: int) -> float:
    """The sum over [lo, lo + n) to the last bit as numpy adds a row, from sums of STEP numbers at most, asked in order."""
    if n <= STEP:
        return part(lo, lo + n)
    half = n // 2
    half -= half % 8
    return _pairwise(part, lo, half) + _pairwise(part, lo + half, n - half)


def _generator(seed: int, at: int) -> np.random.Generator:
    """A generator that has given ``at`` numbers of 32 bits, two of each of its steps."""
    rng = np.random.default_rng(seed)
    rng.bit_generator.advance(at // 2)
    if at % 2:
        rng.integers(0, 1 << 32, dtype=np.uint32)
    return rng


def _refused(k: int, seed: int, at: int, n: int) -> int:
    """How many of n numbers of 32 bits from an even place on are drawn again for an integer below k."""
    raw, least, some = _generator(seed, at).bit_generator, np.uint32((1 << 32) % k), 0
    for lo in range(0, n, STEP):
        some += np.count_nonzero(raw.random_raw(min(STEP, n - lo) // 2).astype("<u8", copy=False).view("<u4") * np.uint32(k) < least)
    return some


def _pieces(spark: SparkSession, sizes: Sequence[int], n_boot: int, seed: int) -> list[tuple[int, int, int, int, int]]:
    """Of each group (its number, first draw, end) and where these begin: a place in the stream and how many integers after it.

    A number that is refused moves all that come after, so tasks first count those of each stretch.
    """
    ends = np.cumsum([-(-n_boot * k // STRETCH) for k in sizes])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            at = np.searchsorted(ends, ids, side="right")
            found = [_refused(sizes[g], seed, int(i - (ends[g - 1] if g else 0)) * STRETCH, STRETCH) for i, g in zip(ids, at)]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(found, pa.int64())], names=["id", "n"])

    total = int(ends[-1])
    rows = spark.range(0, total, 1, min(total, 8 * spark.sparkContext.defaultParallelism)).mapInArrow(count, "id bigint, n bigint").collect()  # one per STRETCH draws
    lost, out = np.zeros(total, np.int64), []
    for r in rows:
        lost[r["id"]] = r["n"]
    for g, k in enumerate(sizes):
        given = np.concatenate([[0], np.cumsum(STRETCH - lost[(ends[g - 1] if g else 0) : ends[g]])])
        step = max(1, PIECE // k)
        for b in range(0, n_boot, step):
            i = int(np.searchsorted(given, b * k, side="right")) - 1
            out.append((g, b, min(b + step, n_boot), i * STRETCH, int(b * k - given[i])))
    return out


_means: dict[tuple[str, int], np.ndarray] = {}


def _held_means(path: str, group: int, k: int) -> np.ndarray:
    """The sorted clusters' means of one written group; a worker keeps those of the last one for its next tasks."""
    if (path, group) not in _means:
        _means.clear()
        x, at = np.empty(k), 0
        for part in saved_parts(path, ["mean"], [("_g", "=", group)]):
            x[at : at + part.num_rows] = part.column("mean").to_numpy()
            at += part.num_rows
        if at != k:
            raise RuntimeError(f"group {group} has {at} clusters instead of {k}")
        _means[path, group] = x
    return _means[path, group]


#: Beside the draws, numbered from 0: the mean, and sums of powers of what the leave-one-out means are below theirs.
_MEAN, _SQUARES, _CUBES = -1, -2, -3


def _moments(x: np.ndarray) -> tuple[float, float, float]:
    k = len(x)
    total = _pairwise(lambda a, b: x[a:b].sum(), 0, k)
    left_out = lambda a, b: (total - x[a:b]) / (k - 1)
    mean = _pairwise(lambda a, b: left_out(a, b).sum(), 0, k) / k

    def power(a: int, b: int, cube: bool) -> float:
        d = mean - left_out(a, b)
        return np.sum(d * d * d if cube else d * d)

    return total / k, _pairwise(lambda a, b: power(a, b, False), 0, k), _pairwise(lambda a, b: power(a, b, True), 0, k)


def _replicates(spark: SparkSession, path: str, sizes: Sequence[int], n_boot: int, seed: int) -> DataFrame:
    """_g, b, v: what :func:`mean_replicates` finds of each written group, to the last bit, a piece of draws at a time."""
    pieces = _pieces(spark, sizes, n_boot, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column("id").to_pylist():
                g, first, end, at, skip = pieces[i]
                k, rng, out = sizes[g], _generator(seed, at), {}
                x, drawn = _held_means(path, g, k), np.empty(STEP)
                for lo in range(0, skip, STEP):
                    rng.integers(0, k, size=min(STEP, skip - lo))
                for b in range(first, end):
                    out[b] = _pairwise(lambda lo, hi: x.take(rng.integers(0, k, size=hi - lo), out=drawn[: hi - lo], mode="clip").sum(), 0, k) / k  # noqa: B023
                if not first:
                    out |= dict(zip((_MEAN, _SQUARES, _CUBES), _moments(x)))
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(out), pa.int32()), pa.array(list(out), pa.int32()), pa.array(list(out.values()), pa.float64())], names=["_g", "b", "v"])

    tasks = min(len(pieces), 16 * spark.sparkContext.defaultParallelism)
    return spark.range(0, len(pieces), 1, tasks).mapInArrow(run, "_g int, b int, v double")


_RESULT = "point double, lo double, hi double, se double"
_COUNTS = "n_clusters bigint, n_rows bigint, n_lost bigint, n_low bigint, n_high bigint"


def _mean_intervals(per: DataFrame, by: Sequence[str], n_boot: int, seed: int, alpha: float, method: str) -> DataFrame:
    """Per group of written clusters the interval of the mean of ``mean``, NULL for fewer than two clusters.

    Clusters without a mean are only counted, in ``n_lost``; ``n_low`` and ``n_high`` are the draws not above
    and not below 0. A group of over ALONE numbers to draw is sorted by all tasks, and each draws pieces of
    it (:func:`_replicates`) with 8 bytes per cluster in memory.
    """
    spark = per.sparkSession
    per = per.select(*by, "cluster", "m", "mean", F.col("mean").isNotNull().alias("_own"))
    sizes = per.groupBy(*by).agg(F.count_if("_own").alias("k"), F.coalesce(F.sum(F.when(F.col("_own"), F.col("m"))), F.lit(0)).alias("rows"), F.count_if(~F.col("_own")).alias("lost"))
    sizes = sizes.where((F.col("k") * n_boot > ALONE) & F.col("k").between(2, (1 << 32) - 1))
    big = sizes.collect()  # one row per ALONE numbers to draw

    def finished(k: int, rows: int, lost: int, found: dict | None, draws: np.ndarray | None) -> dict:
        low = {} if draws is None else {"n_low": np.count_nonzero(draws <= 0), "n_high": np.count_nonzero(draws >= 0)}
        return {**(found or dict.fromkeys(("point", "lo", "hi", "se"))), "n_clusters": k, "n_rows": rows, "n_lost": lost, "n_low": 0, "n_high": 0, **low}

    def alone(pdf: pd.DataFrame) -> dict:
        own = pdf[pdf["_own"]]
        x, counts = own["mean"].to_numpy(float), (len(own), int(own["m"].sum()), len(pdf) - len(own))
        if x.size < 2:
            return finished(*counts, None, None)
        theta, draws, left_out = mean_replicates(x, n_boot, seed)
        return finished(*counts, interval(theta, draws, left_out, alpha, method), draws)

    schema = f"{_RESULT}, {_COUNTS}"
    if not big:
        return _by_group(per, by, alone, schema)
    keys = spark.createDataFrame([(*[r[b] for b in by], g) for g, r in enumerate(big)], StructType([*[sizes.schema[b] for b in by], StructField("_g", IntegerType())]))
    joined = join_groups(per, F.broadcast(keys), by, "left") if by else per.crossJoin(keys)
    path = saved_path(joined.where("_g IS NOT NULL AND _own").select("_g", "cluster", "mean").orderBy("_g", "cluster").select("_g", "mean"), "sorted-means")
    draws = saved(_replicates(spark, path, [r["k"] for r in big], n_boot, seed), "replicates")
    counts = [(r["k"], r["rows"], r["lost"]) for r in big]

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        g, v = int(pdf["_g"].iloc[0]), pdf.set_index("b")["v"].sort_index()
        theta, own = float(v[_MEAN]), v[v.index >= 0].to_numpy()
        bounds = _bca(theta, own, np.float64(v[_SQUARES]), v[_CUBES], alpha) if method == "bca" else None
        return pd.DataFrame([{"_g": g, **finished(*counts[g], _found(theta, own, bounds, alpha), own)}])

    columns = [*by, *[c.split()[0] for c in schema.split(", ")]]
    found = keys.join(draws.groupBy("_g").applyInPandas(together, f"_g int, {schema}"), "_g").select(*columns)
    return found.unionByName(_by_group(joined.where("_g IS NULL").drop("_g"), by, alone, schema).select(*columns)) if by else found


@own_group_names
def cluster_bootstrap(df: DataFrame, value: str, by: Sequence[str] = (), cluster: str = "cluster", n_boot: int = DRAWS, seed: int = 0, alpha: float = ALPHA, method: str = "bca", stat: Callable[[np.ndarray], float] | None = None) -> DataFrame:
    """Interval per group for the mean of cluster means, or for ``stat`` of all values.

    Groups of fewer than two clusters are an error. ``stat`` sees all values of the drawn clusters,
    so its groups have to fit a task.
    """
    _check(method)
    if stat is None:
        found = _mean_intervals(saved(clusters(df, value, by, cluster), "clusters"), by, n_boot, seed, alpha, method)
        few = F.raise_error(F.format_string("an interval needs two clusters or more, not %d", "n_clusters"))
        return found.select(*by, F.when(F.col("n_clusters") >= 2, F.col("point")).otherwise(few).alias("point"), "lo", "hi", "se", "n_clusters", "n_rows")
    v = number(value)
    per = df.select(*by, F.col(cluster).alias("cluster"), v.alias("v")).where("v IS NOT NULL")

    def run(pdf: pd.DataFrame) -> dict:
        parts = [g.to_numpy(float) for _, g in pdf.groupby("cluster", sort=True)["v"]]
        k, rng = len(parts), np.random.default_rng(seed)
        if k < 2:
            raise ValueError(f"an interval needs two clusters or more, not {k}")
        reps = np.array([stat(np.concatenate([parts[i] for i in rng.integers(0, k, size=k)])) for _ in range(n_boot)])
        jack = np.array([stat(np.concatenate(parts[:i] + parts[i + 1 :])) for i in range(k)])
        return interval(float(stat(np.concatenate(parts))), reps, jack, alpha, method) | {"n_clusters": k, "n_rows": len(pdf)}

    return _by_group(per, by, run, f"{_RESULT}, n_clusters bigint, n_rows bigint")


POISSON_STEPS = np.cumsum([np.exp(-1) / np.prod(np.arange(1.0, i + 1)) for i in range(12)])


_BIN = np.arange(1 << 12) / (1 << 12)
#: The weight of a number by its first 12 bits, and where these do not decide.
_FIRST = np.searchsorted(POISSON_STEPS, _BIN)
_OPEN = np.searchsorted(POISSON_STEPS, _BIN + 1 / (1 << 12)) != _FIRST


def poisson_weights(hashes: np.ndarray, draws: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) weights, a row per draw: a function of a cluster's hash, the draw and the seed."""
    out = np.empty((len(draws), len(hashes)))
    t = np.empty(len(hashes), np.uint64)
    with np.errstate(over="ignore"):
        for i, start in enumerate((draws + np.uint64(seed) * np.uint64(1 << 32) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)):
            z = hashes + start
            z ^= np.right_shift(z, np.uint64(30), out=t)
            z *= np.uint64(0xBF58476D1CE4E5B9)
            z ^= np.right_shift(z, np.uint64(27), out=t)
            z *= np.uint64(0x94D049BB133111EB)
            z ^= np.right_shift(z, np.uint64(31), out=t)
            first = np.right_shift(z, np.uint64(52), out=t).view(np.int64)
            out[i] = _FIRST[first]
            rest = np.flatnonzero(_OPEN[first])
            out[i, rest] = np.searchsorted(POISSON_STEPS, (z[rest] >> np.uint64(11)) * 2.0**-53)
    return out


def poisson_sums(per: DataFrame, keys: Sequence[str], values: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """Weighted sums of ``values`` per key and draw: keys, b and each value.

    The same cluster gets the same weight in every group and every attempt, wherever its rows lie.
    Each partition sends ``n_boot`` sums per key it holds, so no group is brought together.
    """
    types = {f.name: f.dataType.simpleString() for f in per.schema}
    head = "".join(f"`{k}` {types[k]}, " for k in keys)

    def part(batches):
        for pdf in batches:
            key = pdf["h"].to_numpy(np.int64).view(np.uint64)
            x = pdf[list(values)].to_numpy(float)
            for own, at in pdf.groupby(list(keys), dropna=False, sort=False).indices.items() if keys else [((), np.arange(len(pdf)))]:
                for lo in range(0, n_boot, 64):
                    b = np.arange(lo, min(lo + 64, n_boot), dtype=np.uint64)
                    sums = poisson_weights(key[at], b, seed) @ x[at]
                    yield pd.DataFrame({**dict(zip(keys, own if isinstance(own, tuple) else (own,))), "b": b.astype(np.int32), **dict(zip(values, sums.T))})

    hashed = per.select(*keys, *[F.col(v).cast("double").alias(v) for v in values], F.xxhash64("cluster").alias("h"))
    sums = hashed.mapInPandas(part, f"{head}b int, {', '.join(f'`{v}` double' for v in values)}")
    return sums.groupBy(*keys, "b").agg(*[F.sum(v).alias(v) for v in values])


def poisson_replicates(per: DataFrame, by: Sequence[str], n_boot: int, seed: int) -> DataFrame:
    """Replicates of the mean of ``mean`` under Poisson(1) weights: by, b, replicate."""
    sums = poisson_sums(per.withColumn("w", F.lit(1.0)), by, ["mean", "w"], n_boot, seed)
    return sums.select(*by, "b", (F.col("mean") / F.nullif("w", F.lit(0.0))).alias("replicate"))


def text_hash_sums(per: DataFrame, value: str, n_boot: int, rows: int = 1 << 14) -> DataFrame:
    """b and the sums s and w of weight * value and weight over all clusters, for weights that SQL can draw.

    A cluster's weight is 0, 1 or 2 by the first 32 bits of the MD5 of draw|cluster. Tasks hash ``rows``
    clusters at once, and each sends its sums once.
    """

    def part(batches):
        found = np.zeros((2, n_boot))
        for table in gathered(batches, rows):
            messages, v = Messages([c.encode() for c in table.column("cluster").to_pylist()]), table.column("v").to_numpy()
            some = ~np.isnan(v)
            for b in range(n_boot):
                h = messages.heads(f"{b}|".encode(), b"")
                w = (h >= np.uint32(1579999999)) + (h >= np.uint32(3159999999)).astype(float)
                found[:, b] += w[some] @ v[some], w.sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_boot, dtype=np.int32)), pa.array(found[0]), pa.array(found[1])], names=["b", "s", "w"])

    keyed = per.select(F.col("cluster").cast("string").alias("cluster"), F.col(value).cast("double").alias("v"))
    return keyed.mapInArrow(part, "b int, s double, w double").groupBy("b").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))


def percentile_bounds(value: str, alpha: float) -> list[Column]:
    """lo and hi of a column of replicates, as aggregates."""
    q = F.percentile(value, F.array(*[F.lit(t) for t in tails(alpha)]))
    return [q[0].alias("lo"), q[1].alias("hi")]


def paired_difference(df: DataFrame, value: str, condition: str, a, b, by: Sequence[str] = (), cluster: str = "cluster") -> DataFrame:
    """Per group and cluster that both conditions saw: the difference of means and its rows; NULL else."""
    v = number(value)
    label = require(F.col(cluster).isNotNull() | v.isNull(), f"a row carries {value} and no {cluster}", F.col(cluster))
    rows = df.where(F.col(condition).isin(a, b)).select(*by, label.alias("cluster"), F.col(condition).alias("c"), v.alias("v")).where("v IS NOT NULL")
    mean = lambda x: F.avg(F.when(F.col("c") == x, F.col("v")))
    return rows.groupBy(*by, "cluster").agg((mean(a) - mean(b)).alias("mean"), F.count("*").alias("m"))


@own_group_names
def paired_point(df: DataFrame, value: str, condition: str, a, b, by: Sequence[str] = (), cluster: str = "cluster") -> DataFrame:
    d = paired_difference(df, value, condition, a, b, by, cluster)
    both = F.col("mean").isNotNull()
    return d.groupBy(*by).agg(F.avg("mean").alias("point"), F.count_if(both).alias("n_clusters"), F.coalesce(F.sum(F.when(both, F.col("m"))), F.lit(0)).alias("n_rows"), F.count_if(~both).alias("n_unpaired"))


@own_group_names
def paired_bootstrap(df: DataFrame, value: str, condition: str, a, b, by: Sequence[str] = (), cluster: str = "cluster", n_boot: int = DRAWS, seed: int = 0, alpha: float = ALPHA, method: str = "bca", engine: str = "exact") -> DataFrame:
    """Interval and two-sided p-value of the mean paired difference, with the unpaired clusters counted."""
    _check(method, engine)
    if engine == "poisson":
        per = paired_difference(df, value, condition, a, b, by, cluster)
        both = F.col("mean").isNotNull()
        sizes = per.groupBy(*by).agg(F.avg("mean").alias("point"), F.count_if(both).alias("n_clusters"), F.sum(F.when(both, F.col("m"))).alias("n_rows"), F.count_if(~both).alias("n_unpaired"))
        least, n = (F.least(F.count_if(F.col("replicate") <= 0), F.count_if(F.col("replicate") >= 0)), F.count("replicate"))
        spread = poisson_replicates(per.where(both), by, n_boot, seed).groupBy(*by).agg(*percentile_bounds("replicate", alpha), F.stddev_samp("replicate").alias("se"), F.least(F.lit(1.0), F.greatest(2 * least / n, 1 / n)).alias("p"))
        joined = join_groups(sizes, spread, by) if by else sizes.crossJoin(spread)
        enough = require(F.col("n_clusters") >= 2, "a paired interval needs two clusters that both conditions saw", F.col("point"))
        return joined.select(*by, enough.alias("point"), "lo", "hi", "se", "n_clusters", "n_rows", "n_unpaired", "p")

    per = saved(paired_difference(df, value, condition, a, b, by, cluster).withColumn("mean", number("mean")), "differences")
    found = _mean_intervals(per, by, n_boot, seed, alpha, method)
    enough = require(F.col("n_clusters") >= 2, "a paired interval needs two clusters that both conditions saw", F.col("point"))
    p = F.least(F.lit(1.0), F.greatest(2 * F.least("n_low", "n_high") / n_boot, F.lit(1 / n_boot)))
    return found.select(*by, enough.alias("point"), "lo", "hi", "se", "n_clusters", "n_rows", F.col("n_lost").alias("n_unpaired"), p.alias("p"))


# == summary ==


def few_clusters(k: Column) -> Column:
    """The caveat of an interval over fewer than 20 clusters."""
    near, share = F.lit(3), F.lit(COVERAGE[3])
    for c, s in COVERAGE.items():
        near, share = F.when(k >= c, c).otherwise(near), F.when(k >= c, s).otherwise(share)
    text = F.format_string("only %d clusters: the interval is too narrow (a nominal 95%% interval covers ~%d%% at k=%d)", k, share, near)
    return F.when((k > 0) & (k < FEW), text)


def cell_caveats(k: Column, se: Column, n_rows: Column, n_excluded: Column) -> Column:
    share = ratio(n_excluded, n_rows + n_excluded)
    lost = F.format_string("%s%% of rows have no value: the estimate describes the survivors (see attrition)", F.bround(100 * share, 0).cast("int"))
    flat = F.when(se == 0, "no spread in the values: a zero-width interval, not certainty")
    return F.concat_ws("; ", few_clusters(k), flat, F.when(share > EXCLUDED, lost))


@own_group_names
def summarize(df: DataFrame, value: str, by: Sequence[str], cluster: str = "cluster", n_boot: int = DRAWS // 2, seed: int = 0, alpha: float = ALPHA, method: str = "bca", label: str | None = None, floor: Mapping[str, float] | None = None, higher_is_better: bool = True, engine: str = "exact") -> DataFrame:
    """One row per group: estimate, interval, honest sample sizes, floors to beat and caveats.

    A group with fewer than two clusters gets the mean of its rows and no interval. ``label`` adds
    the floors of trivial predictors of that column, ``floor`` stated ones; ``above_floor_ci`` asks
    whether the interval clears the strongest.
    """
    from plumbline.operators.floors import binding_floor

    _check(method, engine)
    by = list(by)
    per = clusters(df, value, by, cluster)
    per = saved(per, "clusters") if engine == "exact" else per
    sizes = _cluster_mean(per, df, value, by)
    plain = df.select(*by, number(value).alias("v")).groupBy(*by).agg(F.avg("v").alias("row_mean"))
    if engine == "exact":
        spread = _mean_intervals(per, by, n_boot, seed, alpha, method).select(*by, "lo", "hi", "se")
    else:
        spread = poisson_replicates(per, by, n_boot, seed).groupBy(*by).agg(*percentile_bounds("replicate", alpha), F.stddev_samp("replicate").alias("se"))
    c = F.col
    out = join_groups(join_groups(join_groups(sizes, spread, by, "left"), _effective(_icc(per, by)).select(*by, "rho", "m0", "deff", "n_eff"), by, "left"), plain, by, "left")
    enough = c("n_clusters") >= 2
    out = out.select(
        *by, F.when(enough, c("point")).otherwise(c("row_mean")).alias("point"), *[F.when(enough, c(x)).alias(x) for x in ("lo", "hi", "se")],
        "n_clusters", "n_rows", F.when(enough, F.lit(method if engine == "exact" else "poisson")).otherwise(F.format_string("skipped: an interval needs two clusters, not %d", "n_clusters")).alias("ci_method"),
        "n_excluded", "rho", "m0", "deff", "n_eff",
    )
    if label is not None or floor is not None:
        out = join_groups(out, binding_floor(df, by, label, floor, higher_is_better), by, "left")
        sign = 1 if higher_is_better else -1
        bound = c("lo") if higher_is_better else c("hi")
        out = out.withColumn("headroom", sign * (c("point") - c("floor_value"))).withColumn("above_floor_ci", F.coalesce(sign * (bound - c("floor_value")) > 0, F.lit(False)))
    return out.withColumn("caveats", cell_caveats(c("n_clusters"), c("se"), c("n_rows"), c("n_excluded")))


# == closed forms ==


def wilson(k: Column, n: Column, alpha: float = 0.05) -> tuple[Column, Column]:
    """The score interval of a proportion of independent items; NULL where n is 0."""
    z = NORMAL.inv_cdf(1 - alpha / 2)
    p, z2n = ratio(k, n), ratio(F.lit(z * z), n)
    half = F.lit(z) * F.sqrt(ratio(p * (1 - p), n) + z2n / (4 * n)) / (1 + z2n)
    centre = (p + z2n / 2) / (1 + z2n)
    ok = p.isNotNull()
    return F.when(ok, F.greatest(F.lit(0.0), centre - half)), F.when(ok, F.least(F.lit(1.0), centre + half))


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p of discordant counts: twice the lower binomial tail, summed in logarithms."""
    n, m = b + c, F.least(b, c).cast("int")
    first = -n * F.lit(float(np.log(2)))
    step = lambda a, i: F.struct((a["t"] + F.log((n - i + 1) / i)).alias("t"), (a["s"] + F.exp(a["t"] + F.log((n - i + 1) / i))).alias("s"))
    tail = F.aggregate(F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>")), F.struct(first.alias("t"), F.exp(first).alias("s")), step, lambda a: a["s"])
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * tail))


def benjamini_hochberg(df: DataFrame, p: str, q: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``reject``: ranks up to the largest that passes its threshold; equal p share a fate."""
    m = F.count(p).over(Window.partitionBy(*by))
    rank = F.count(p).over(Window.partitionBy(*by).orderBy(F.col(p)))
    passed = F.max(F.when(F.col(p) <= F.col("_r") / F.col("_m") * q, F.col(p)))
    ranked = df.withColumn("_m", m).withColumn("_r", rank)
    return ranked.withColumn("_top", passed.over(Window.partitionBy(*by))).withColumn("reject", F.coalesce(F.col(p) <= F.col("_top"), F.lit(False))).drop("_m", "_r", "_top")


def holm(df: DataFrame, p: str, alpha: float = 0.05, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``reject``: ranks before the first that fails; a missing p is refused."""
    value = require(number(p).isNotNull(), "a p-value is missing", number(p))
    ranked = df.withColumn("_p", value).withColumn("_m", F.count("*").over(Window.partitionBy(*by))).withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_p")))
    fails = F.min(F.when(F.col("_p") > F.lit(alpha) / (F.col("_m") - F.col("_r") + 1), F.col("_r"))).over(Window.partitionBy(*by))
    return ranked.withColumn("_f", fails).withColumn("reject", F.coalesce(F.col("_r") < F.col("_f"), F.lit(True))).drop("_p", "_m", "_r", "_f")


def ratio_se(num: Column, den: Column) -> Column:
    """Aggregate over clusters: the cluster-robust error of sum(num) / sum(den).

    From sums of squares and products; NULL with fewer than two clusters or two that hold the domain.
    """
    n, d, k = num.cast("double"), den.cast("double"), F.count(F.lit(1))
    total = F.nullif(F.sum(d), F.lit(0.0))
    r = F.sum(n) / total
    squares = F.greatest(F.lit(0.0), F.sum(n * n) - 2 * r * F.sum(n * d) + r * r * F.sum(d * d))
    ok = (k >= 2) & (F.count_if(d > 0) >= 2)
    return F.when(ok, F.sqrt(k / F.nullif(k - 1, F.lit(0)) * squares) / total)
