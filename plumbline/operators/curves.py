"""Curves along a numeric axis over items that are there at every point.

Points come from DataFrame expressions. Replicates come from numpy over the clusters' sums per axis
point, one group of curves per task: the same clusters are drawn at every point.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import join_groups, number, require
from plumbline.sources.tables import gathered, saved

CENSORED = 0.10


def explode_tokens(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row per position of parallel arrays, counted from 0; rows without arrays go."""
    zipped = df.where(F.col(cols[0]).isNotNull()).withColumn("_z", F.arrays_zip(*cols))
    rest = [c for c in df.columns if c not in cols]
    out = zipped.select(*rest, F.posexplode("_z").alias("position", "_t"))
    return out.select(*rest, "position", *[F.col("_t")[c].alias(c) for c in cols])


def align(df: DataFrame, x: str, usable: Column, by: Sequence[str] = (), item: str = "item_id", log_x: bool = True) -> DataFrame:
    """Usable rows of the items that are there at every value of the axis of their group.

    A non-numeric axis, two rows of one item at one point and, on a log axis, values of 0 or less are
    refused.
    """
    if df.schema[x].dataType.typeName() in ("string", "boolean", "binary"):
        raise ValueError(f"the axis {x} must be numeric")
    ok = usable & (F.coalesce("status", F.lit("ok")) == "ok") if "status" in df.columns else usable
    axis = F.col(x).cast("double")
    if log_x:
        axis = require(axis > 0, f"{x} has values of 0 or less: use log_x=False", axis)
    rows = df.where(ok).withColumn("_x", axis).withColumn("_item", F.col(item))
    n_x = rows.select(*by, "_x").distinct().groupBy(*by).agg(F.count("*").alias("_n_x"))
    per = rows.groupBy(*by, "_item").agg(F.count("*").alias("_rows"), F.count_distinct("_x").alias("_xs"))
    once = require(F.col("_rows") == F.col("_xs"), f"an item has two rows at one {x}", F.col("_xs"))
    whole = (join_groups(per, n_x, by) if by else per.crossJoin(F.broadcast(n_x))).where(once == F.col("_n_x")).select(*by, "_item")
    return _semi(rows, whole, [*by, "_item"])


def _semi(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    renamed = right.select(*[F.col(k).alias(f"__{k}") for k in keys])
    test = F.lit(True)
    for k in keys:
        test &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(renamed, test, "left_semi")


def n_dropped(df: DataFrame, x: str, usable: Column, by: Sequence[str] = (), item: str = "item_id", log_x: bool = True) -> DataFrame:
    """Per group: items of the frame, those kept, and those dropped for a missing point."""
    kept = align(df, x, usable, by, item, log_x).select(*by, "_item").distinct().groupBy(*by).agg(F.count("*").alias("n_items"))
    every = df.select(*by, item).distinct().groupBy(*by).agg(F.count("*").alias("n_all"))
    out = join_groups(every, kept, by, "left") if by else every.crossJoin(kept)
    return out.select(*by, F.coalesce("n_items", F.lit(0)).alias("n_items"), (F.col("n_all") - F.coalesce("n_items", F.lit(0))).alias("n_dropped"))


def susceptibility(curve: DataFrame, y: str, by: Sequence[str] = (), x: str = "x", log_x: bool = True, name: str = "chi") -> DataFrame:
    """``curve`` with dy / dlog x: centred on a non-uniform grid, one-sided at the ends."""
    u = F.log(x) if log_x else F.col(x).cast("double")
    w = Window.partitionBy(*by).orderBy(x)
    d = curve.withColumn("_u", u)
    h1, h2 = F.col("_u") - F.lag("_u").over(w), F.lead("_u").over(w) - F.col("_u")
    f0, f2, f = F.lag(y).over(w), F.lead(y).over(w), F.col(y)
    d = d.withColumn("_h1", h1).withColumn("_h2", h2).withColumn("_f0", f0).withColumn("_f2", f2)
    a, b, p, q = (F.col(c) for c in ("_h1", "_h2", "_f0", "_f2"))
    inner = (a * a * q + (b * b - a * a) * f - b * b * p) / (a * b * (a + b))
    chi = F.when(a.isNull(), (q - f) / b).when(b.isNull(), (f - p) / a).otherwise(inner)
    return d.withColumn(name, chi).drop("_u", "_h1", "_h2", "_f0", "_f2")


def value_curve(df: DataFrame, x: str, value: str, by: Sequence[str] = (), item: str = "item_id", log_x: bool = True) -> DataFrame:
    """by, x, n items, mean and chi of a value over the aligned items."""
    rows = align(df, x, number(value).isNotNull(), by, item, log_x)
    mean = rows.groupBy(*by, "_x").agg(F.count("*").alias("n"), F.avg(number(value)).alias("mean")).withColumnRenamed("_x", "x")
    return susceptibility(mean, "mean", by, "x", log_x)


def peak(curve: DataFrame, by: Sequence[str] = (), chi: str = "chi", x: str = "x") -> DataFrame:
    """Where chi is largest, the first such x, and whether that is an end of the grid."""
    out = curve.groupBy(*by).agg(F.max_by(x, F.struct(F.col(chi), -F.col(x))).alias("peak_x"), F.max(chi).alias("peak_chi"), F.min(x).alias("_a"), F.max(x).alias("_b"))
    return out.select(*by, "peak_x", "peak_chi", (F.col("peak_x").isin(F.col("_a"), F.col("_b"))).alias("peak_at_edge"))


def crossing(curve: DataFrame, y: str, level: float, by: Sequence[str] = (), x: str = "x", log_x: bool = True) -> DataFrame:
    """The first x where the curve meets the level, linear in log x; NULL where it never does."""
    u = F.log(x) if log_x else F.col(x).cast("double")
    d = curve.select(*by, F.col(x).alias("x"), u.alias("u"), (F.col(y) - level).alias("y"))
    wx = Window.partitionBy(*by).orderBy("x")
    d = d.withColumn("u1", F.lead("u").over(wx)).withColumn("y1", F.lead("y").over(wx))
    c = F.col
    at = F.when(c("y") == 0, c("u")).when(c("y") * c("y1") < 0, c("u") + (c("u1") - c("u")) * (-c("y")) / (c("y1") - c("y")))
    found = d.withColumn("at", at).groupBy(*by).agg(F.min_by("at", F.when(c("at").isNotNull(), c("x"))).alias("at"))
    return found.select(*by, (F.exp("at") if log_x else c("at")).alias("crossing"))


def _token_sums(rows: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Counts and hits of 0/1 arrays ``ok`` per key, length and position, and per key and length."""
    sized = rows.select(*keys, "ok", F.size("ok").alias("len"))
    right = F.forall("ok", lambda v: v.cast("boolean")).cast("double")
    whole = sized.groupBy(*keys, "len").agg(F.count("*").alias("n"), F.sum(right).alias("s"))
    token = F.col("v").cast("boolean").cast("double")
    at = sized.select(*keys, "len", F.posexplode("ok").alias("j", "v")).groupBy(*keys, "len", "j").agg(F.count("*").alias("n"), F.sum(token).alias("s"))
    return whole, at


def _composed(whole: DataFrame, at: DataFrame, k: Sequence[str]) -> DataFrame:
    """Composition quantities per ``k`` from sums per length and position; weights may be any numbers."""
    share, c = F.col("s") / F.nullif(F.col("n").cast("double"), F.lit(0.0)), F.col
    seen = at.where("n > 0")
    pooled = seen.groupBy(*k, "j").agg((F.sum("s") / F.sum("n")).alias("m"))
    running = Window.partitionBy(*k).orderBy("j")
    marg = pooled.withColumn("ms", F.collect_list("m").over(running)).select(*k, (F.col("j") + 1).alias("len"), F.aggregate("ms", F.lit(1.0), lambda a, b: a * b).alias("pred"))
    within = seen.groupBy(*k, "len").agg(F.aggregate(F.collect_list(share), F.lit(1.0), lambda a, b: a * b).alias("pred_l"))
    used = whole.where("n > 0")
    lengths = join_groups(join_groups(used, marg, [*k, "len"], "left"), within, [*k, "len"], "left").na.fill(1.0, ["pred", "pred_l"])
    total = lengths.groupBy(*k).agg(
        F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("A_obs"), (F.sum(c("n") * c("pred")) / F.sum("n")).alias("A_pred"), (F.sum(c("n") * c("pred_l")) / F.sum("n")).alias("A_pred_lc"),
    )
    rate = seen.groupBy(*k).agg((F.sum("s") / F.sum("n")).alias("p"))
    out = join_groups(total, rate, k, "left")
    return out.select(*k, "n", "p", "A_obs", "A_pred", "A_pred_lc", (c("A_obs") - c("A_pred")).alias("phi"), (c("A_obs") - c("A_pred_lc")).alias("phi_lc"))


def composition_points(df: DataFrame, x: str, ok: str, by: Sequence[str] = (), item: str = "item_id", log_x: bool = True) -> DataFrame:
    """Per axis point: A_obs, p, A_pred, A_pred_lc, phi and phi_lc from per-token 0/1 arrays.

    Marginals are by position, pooled and within lengths; a prediction is the product over the
    positions of an item. Only (x, length, position) sums are joined.
    """
    rows = align(df, x, F.col(ok).isNotNull(), by, item, log_x).select(*by, F.col("_x").alias("x"), F.col(ok).alias("ok"))
    return _composed(*_token_sums(rows, [*by, "x"]), [*by, "x"])


def _stacked(points: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """by, b, quantity, x and value of named columns, a row each."""
    names = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in columns)
    x = "x" if "x" in points.columns else "CAST(NULL AS DOUBLE) AS x"
    return points.selectExpr(*[f"`{b}`" for b in by], "b", x, f"stack({len(columns)}, {names}) AS (quantity, value)")


def _summed(long: DataFrame, by: Sequence[str], alpha: float) -> DataFrame:
    """Points (b = -1) with percentile bounds and the share of draws without a value."""
    from plumbline.operators.statistics import percentile_bounds

    drawn = F.col("b") >= 0
    out = long.withColumn("r", F.when(drawn, F.col("value"))).groupBy(*by, "quantity", "x").agg(
        F.max(F.when(~drawn, F.col("value"))).alias("point"), *percentile_bounds("r", alpha), (1 - F.count("r") / F.count_if(drawn)).alias("censored"),
    )
    return out.select(*by, "quantity", "x", "point", "lo", "hi", "censored")


def _peak_rows(curve: DataFrame, keys: Sequence[str], chi: str) -> DataFrame:
    return peak(curve, keys, chi).withColumn("peak_at_edge", F.col("peak_at_edge").cast("double"))


def _value_draws(sums: DataFrame, by: Sequence[str], levels: Sequence[float], n_boot: int, seed: int, alpha: float, log_x: bool) -> DataFrame:
    """:func:`value_curves` by hashed Poisson weights: sums per cluster and point stay where they are."""
    from plumbline.operators.statistics import poisson_sums

    per = sums.withColumnRenamed("_x", "x")
    whole = per.groupBy(*by, "x").agg(F.sum("s").alias("s"), F.sum("n").cast("double").alias("n")).withColumn("b", F.lit(-1))
    every = whole.unionByName(poisson_sums(per, [*by, "x"], ["s", "n"], n_boot, seed))
    keys = [*by, "b"]
    curve = susceptibility(every.select(*keys, "x", (F.col("s") / F.nullif("n", F.lit(0.0))).alias("mean")), "mean", keys, "x", log_x)
    long = _stacked(curve, by, ["mean", "chi"]).unionByName(_stacked(_peak_rows(curve, keys, "chi"), by, ["peak_chi", "peak_x", "peak_at_edge"]))
    for v in levels:
        long = long.unionByName(_stacked(crossing(curve, "mean", v, keys, "x", log_x).withColumnRenamed("crossing", f"crossing_{v:g}"), by, [f"crossing_{v:g}"]))
    return _summed(long, by, alpha)


def _token_draws(rows: DataFrame, k: Sequence[str], n_boot: int, seed: int, size: int = 1 << 13) -> DataFrame:
    """:func:`_token_sums` of every draw b, -1 being the rows as they are; sums of whole items have no j.

    A row's weights are made once for all its tokens. Tasks take ``size`` rows at once, those of one key
    and length as a matrix product, and send sums.
    """
    from plumbline.operators.statistics import poisson_weights

    token = F.transform("ok", lambda v: F.coalesce(v.cast("boolean"), F.lit(False)).cast("int"))
    slim = rows.select(*k, F.xxhash64("cluster").alias("h"), token.alias("ok"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in slim.select(*k).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        kinds: list[pa.DataType] = []

        def sent() -> Iterator[pa.RecordBatch]:
            b = np.arange(-1, n_boot, dtype=np.int32)
            for key, found in held.items():
                n = key[-1]  # columns: tokens, whole items, rows
                own = [pa.repeat(pa.scalar(v, t), len(b) * (n + 1)) for v, t in zip(key, kinds)]
                j = np.repeat(np.arange(n + 1, dtype=np.int32), len(b))
                yield pa.RecordBatch.from_arrays(
                    [*own, pa.repeat(pa.scalar(n, pa.int32()), len(j)), pa.array(j, mask=j == n), pa.array(np.tile(b, n + 1)), pa.array(np.tile(found[:, n + 1], n + 1)), pa.array(found[:, : n + 1].T.ravel())],
                    names=[*k, "len", "j", "b", "n", "s"],
                )
            held.clear()

        for table in gathered(batches, size):
            kinds = [table.schema.field(c).type for c in k]
            ok = table.column("ok").combine_chunks()
            lengths, values = pc.list_value_length(ok).to_numpy(), ok.flatten().to_numpy()
            starts = np.cumsum(lengths) - lengths
            group = np.zeros(len(lengths), np.int64)
            for codes in (*(table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy() for c in k), lengths):
                group = np.unique(group * (int(codes.max()) + 1) + codes, return_inverse=True)[1]
            order = np.argsort(group, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(group[order], prepend=-1)), len(order))
            hashes = table.column("h").to_numpy().view(np.uint64)[order]
            w = np.vstack([np.ones((1, len(order))), poisson_weights(hashes, np.arange(n_boot, dtype=np.uint64), seed)])
            for lo, hi in zip(cuts, cuts[1:]):
                at, n = order[lo:hi], int(lengths[order[lo]])
                hits = values[starts[at][:, None] + np.arange(n)].astype(float) if n else np.zeros((len(at), 0))
                found = w[:, lo:hi] @ np.column_stack([hits, hits.all(axis=1), np.ones(len(at))])
                key = (*(table.column(c)[int(at[0])].as_py() for c in k), n)
                held[key] = held[key] + found if key in held else found
            if sum(f.size for f in held.values()) > 1 << 23:
                yield from sent()
        yield from sent()

    drawn = slim.mapInArrow(run, f"{head}len int, j int, b int, n double, s double")
    return drawn.groupBy(*k, "len", "j", "b").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def _axis_draws(rows: DataFrame, by: Sequence[str], n_boot: int, seed: int, alpha: float, log_x: bool) -> DataFrame:
    """:func:`axis_curves` by hashed Poisson weights over sums per length and position."""
    k, keys = [*by, "x"], [*by, "x", "b"]
    sums = saved(_token_draws(rows.withColumnRenamed("_x", "x"), k, n_boot, seed), "token-draws")
    parts = [sums.where("j IS NULL").drop("j"), sums.where("j IS NOT NULL")]
    points = _composed(*parts, keys)
    kinds = ("obs", "pred", "pred_lc")
    for kind in kinds:
        points = susceptibility(points, f"A_{kind}", [*by, "b"], "x", log_x, f"chi_{kind}")
    right, product = F.col("s") / F.col("n"), F.col("pred_l")
    used = parts[0].where("n > 0")
    within = parts[1].where("n > 0").groupBy(*keys, "len").agg(F.aggregate(F.collect_list(F.col("s") / F.col("n")), F.lit(1.0), lambda a, b: a * b).alias("pred_l"))
    lengths = join_groups(used, within, [*keys, "len"], "left").na.fill(1.0, ["pred_l"]).select(*by, "b", "x", F.concat(F.lit("phi_l"), "len").alias("quantity"), (right - product).alias("value"))
    best = points.groupBy(*by, "b").agg(F.max_by(F.struct("chi_obs", "chi_pred", "chi_pred_lc"), F.struct("chi_obs", -F.col("x"))).alias("t"))
    gaps = best.select(*by, "b", *[(F.col("t.chi_obs") - F.col(f"t.chi_{kind}")).alias(f"peak_chi_gap{end}") for kind, end in (("pred", ""), ("pred_lc", "_lc"))])
    long = _stacked(points, by, ["p", "A_obs", "A_pred", "A_pred_lc", "phi", "phi_lc", *[f"chi_{kind}" for kind in kinds]])
    long = long.unionByName(lengths).unionByName(_stacked(_peak_rows(points, [*by, "b"], "chi_obs"), by, ["peak_chi", "peak_x", "peak_at_edge"])).unionByName(_stacked(gaps, by, ["peak_chi_gap", "peak_chi_gap_lc"]))
    return _summed(long, by, alpha)


# == replicates ==


def draw_weights(rng: np.random.Generator, clusters: int, draws: int, take: int | None = None) -> np.ndarray:
    """A row of cluster weights per draw: how often each is drawn, or 1 for ``take`` of them and else 0."""
    if take is None:
        even = np.full(clusters, 1.0 / clusters)
        return rng.multinomial(clusters, even, size=draws) * 1.0
    if take < 1 or take > clusters:
        raise ValueError(f"a subsample of {take} is not possible with {clusters} clusters")
    rank = np.argsort(np.argsort(rng.random((draws, clusters)), axis=1), axis=1)
    return np.where(rank < take, 1.0, 0.0)


def gradient(x: np.ndarray, y: np.ndarray, log_x: bool) -> np.ndarray:
    return np.gradient(y, np.log(x) if log_x else x, axis=-1)


def first_crossing(x: np.ndarray, y: np.ndarray, level: float, log_x: bool) -> np.ndarray:
    """Per row of y; NaN where the level is never met."""
    u = np.log(x) if log_x else x
    z = y - level
    flip = np.zeros(z.shape, bool)
    flip[:, :-1] = z[:, :-1] * z[:, 1:] < 0
    meets = (z == 0) | flip
    j = np.argmax(meets, axis=1)
    row = np.arange(len(z))
    y0, y1 = z[row, j], z[row, np.minimum(j + 1, len(x) - 1)]
    step = np.where(y0 == 0, 0.0, -y0 / np.where(y1 == y0, 1.0, y1 - y0))
    at = u[j] + (u[np.minimum(j + 1, len(x) - 1)] - u[j]) * step
    at = np.where(meets.any(axis=1), at, np.nan)
    return np.exp(at) if log_x else at


def _peaks(x: np.ndarray, chi: np.ndarray) -> dict[str, np.ndarray]:
    top = chi.argmax(axis=1)
    return {"peak_chi": chi.max(axis=1), "peak_x": x[top], "peak_at_edge": np.isin(top, (0, len(x) - 1)) * 1.0}


def _long(x: np.ndarray, point: dict, reps: dict, alpha: float) -> pd.DataFrame:
    """quantity, x (NULL for scalars), point, lo, hi and the share of replicates without a value."""
    out = []
    for name, value in point.items():
        v, r = np.atleast_1d(value), reps[name]
        r = r[:, None] if r.ndim == 1 else r
        for i in range(len(v)):
            fine = r[:, i][np.isfinite(r[:, i])]
            lo, hi = np.quantile(fine, [alpha / 2, 1 - alpha / 2]) if fine.size else (np.nan, np.nan)
            out.append((name, x[i] if np.ndim(value) else None, v[i], lo, hi, float(1 - fine.size / len(r))))
    table = pd.DataFrame(out, columns=["quantity", "x", "point", "lo", "hi", "censored"])
    return table.astype({"x": float}).where(table.notna(), None)


_CURVE = "quantity string, x double, point double, lo double, hi double, censored double"


def _codes(labels: pd.Series) -> np.ndarray:
    return pd.factorize(labels)[0]


def _grouped(rows: DataFrame, by: Sequence[str], run, schema: str) -> DataFrame:
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = run(pdf)
        for i, b in enumerate(by):
            out.insert(i, b, pdf[b].iloc[0])
        return out

    keyed = rows if by else rows.withColumn("_all", F.lit(1))
    head = "".join(f"`{b}` {types[b]}, " for b in by)
    return keyed.groupBy(*(by or ["_all"])).applyInPandas(one, head + schema)


def value_curves(df: DataFrame, x: str, value: str, by: Sequence[str] = (), item: str = "item_id", cluster: str = "cluster", levels: Sequence[float] = (), n_boot: int = 1000, seed: int = 0, alpha: float = 0.05, log_x: bool = True, engine: str = "exact", chunk: int = 256) -> DataFrame:
    """Long table of mean, chi, peak and crossings with percentile intervals, per group.

    Rows are summed per cluster and axis point before they meet. With ``engine="exact"`` a task sees k
    clusters by axis points of a group, and ``chunk`` draws at a time; with ``"poisson"`` no group meets.
    """
    rows = align(df, x, number(value).isNotNull(), by, item, log_x)
    label = require(F.col(cluster).isNotNull(), f"an item has no {cluster}", F.col(cluster))
    sums = rows.select(*by, "_x", label.alias("cluster"), number(value).alias("v"), "_item").groupBy(*by, "cluster", "_x").agg(F.sum("v").alias("s"), F.count("*").alias("n"), F.min("_item").alias("first"))
    if engine == "poisson":
        return _value_draws(sums, by, levels, n_boot, seed, alpha, log_x)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xs = np.sort(pdf["_x"].unique())
        if len(xs) < 2:
            raise ValueError("a curve needs two axis points or more")
        order = pdf.groupby("cluster")["first"].min().sort_values(kind="stable").index
        s = pdf.pivot(index="cluster", columns="_x", values="s").loc[order, xs].to_numpy(float)
        n = pdf.pivot(index="cluster", columns="_x", values="n").loc[order, xs].to_numpy(float)
        k, rng = len(s), np.random.default_rng(seed)
        drawn = (draw_weights(rng, k, min(chunk, n_boot - i)) for i in range(0, n_boot, chunk))
        mean = np.vstack([(w @ s) / (w @ n) for w in itertools.chain([np.ones((1, k))], drawn)])
        chi = gradient(xs, mean, log_x)
        every = {"mean": mean, "chi": chi, **_peaks(xs, chi), **{f"crossing_{v:g}": first_crossing(xs, mean, v, log_x) for v in levels}}
        return _long(xs, {q: a[0] for q, a in every.items()}, {q: a[1:] for q, a in every.items()}, alpha)

    return _grouped(sums, by, run, _CURVE)


def axis_bootstrap(df: DataFrame, x: str, value: str, stat: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]], by: Sequence[str] = (), item: str = "item_id", cluster: str = "cluster", n_boot: int = 1000, seed: int = 0, alpha: float = 0.05, log_x: bool = True, chunk: int = 256) -> DataFrame:
    """Long table of any statistic of a curve: ``stat(x, means)`` turns (draws, points) means into named arrays.

    Clusters are drawn by hash; sums per cluster and point stay where they are, and a task sees a
    group's draws by axis points.
    """
    from plumbline.operators.statistics import poisson_sums

    rows = align(df, x, number(value).isNotNull(), by, item, log_x)
    per = rows.select(*by, F.col("_x").alias("x"), F.col(cluster).alias("cluster"), number(value).alias("v")).groupBy(*by, "cluster", "x").agg(F.sum("v").alias("s"), F.count("*").alias("n"))
    whole = per.groupBy(*by, "x").agg(F.sum("s").alias("s"), F.sum("n").cast("double").alias("n")).withColumn("b", F.lit(-1))
    every = whole.unionByName(poisson_sums(per, [*by, "x"], ["s", "n"], n_boot, seed))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        means = pdf.assign(m=pdf["s"] / pdf["n"].where(pdf["n"] > 0)).pivot(index="b", columns="x", values="m").sort_index()
        xs = means.columns.to_numpy(float)
        made = [stat(xs, means.to_numpy(float)[i : i + chunk]) for i in range(0, len(means), chunk)]
        found = {q: np.concatenate([np.asarray(m[q], float) for m in made]) for q in made[0]}
        return _long(xs, {q: a[0] for q, a in found.items()}, {q: a[1:] for q, a in found.items()}, alpha)

    return _grouped(every, by, run, _CURVE)


def composition(w: np.ndarray, ok: np.ndarray, valid: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Weighted composition quantities of one axis point for (B, k) weights of items."""
    total = w.sum(axis=1)
    hits, every = ok * valid, np.where(valid, ok, 1.0).prod(axis=1)
    obs = (w @ every) / total

    def marginal(v: np.ndarray) -> np.ndarray:
        seen = v @ valid
        return np.divide(v @ hits, seen, out=np.full(seen.shape, np.nan), where=seen > 0)

    run = np.pad(np.cumprod(marginal(w), axis=1), ((0, 0), (1, 0)), constant_values=1.0)
    pred = np.where(w > 0, w * run[:, n], 0.0).sum(axis=1) / total
    by_length, out = np.zeros(len(w)), {}
    for length in np.unique(n):
        own = w * (n == length)
        size = own.sum(axis=1)
        product = np.prod(marginal(own)[:, :length], axis=1)
        right = np.divide(own @ every, size, out=np.full(size.shape, np.nan), where=size > 0)
        by_length += np.where(size > 0, size / total * product, 0.0)
        out[f"phi_l{length}"] = np.where(size > 0, right - product, np.nan)
    p = (w @ hits).sum(axis=1) / (w @ valid.astype(float)).sum(axis=1)
    return {"p": p, "A_obs": obs, "A_pred": pred, "A_pred_lc": by_length, "phi": obs - pred, "phi_lc": obs - by_length, **out}


def _matrices(pdf: pd.DataFrame):
    """Axis values, cluster codes, and (ok, valid, lengths) per axis value, items in order."""
    xs = np.sort(pdf["_x"].unique())
    items = np.array(sorted(pdf["_item"].unique()))
    parts, codes = [], None
    for v in xs:
        g = pdf[pdf["_x"] == v].set_index("_item").loc[items]
        codes = _codes(g["cluster"]) if codes is None else codes
        n = g["ok"].map(len).to_numpy(int)
        ok = np.zeros((len(items), n.max()))
        for i, seq in enumerate(g["ok"]):
            ok[i, : n[i]] = seq
        parts.append((ok, np.arange(n.max())[None, :] < n[:, None], n))
    return xs, codes, parts


def axis_curves(df: DataFrame, x: str, ok: str, by: Sequence[str] = (), item: str = "item_id", cluster: str = "cluster", n_boot: int = 1000, seed: int = 0, alpha: float = 0.05, log_x: bool = True, chunk: int = 256, engine: str = "exact") -> DataFrame:
    """Long table of the composition quantities, their chi and peak, with percentile intervals.

    ``engine="exact"`` brings a group's items to one task; ``"poisson"`` moves sums per cluster, length
    and position only.
    """
    rows = align(df, x, F.col(ok).isNotNull(), by, item, log_x).select(*by, "_x", "_item", F.col(cluster).alias("cluster"), F.col(ok).alias("ok"))
    if engine == "poisson":
        return _axis_draws(rows, by, n_boot, seed, alpha, log_x)

    def curves(w: np.ndarray, xs: np.ndarray, parts: list) -> dict[str, np.ndarray]:
        points = [composition(w, *p) for p in parts]
        empty = np.full(len(w), np.nan)
        out = {q: np.stack([p.get(q, empty) for p in points], axis=1) for q in sorted(set().union(*points))}
        out |= {f"chi_{kind}": gradient(xs, out[f"A_{kind}"], log_x) for kind in ("obs", "pred", "pred_lc")}
        i, row = np.argmax(out["chi_obs"], axis=1), np.arange(len(w))
        gaps = {"peak_chi_gap": out["chi_obs"][row, i] - out["chi_pred"][row, i], "peak_chi_gap_lc": out["chi_obs"][row, i] - out["chi_pred_lc"][row, i]}
        return {**out, **_peaks(xs, out["chi_obs"]), **gaps}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        xs, codes, parts = _matrices(pdf)
        k, rng = codes.max() + 1, np.random.default_rng(seed)
        point = {q: a[0] for q, a in curves(np.ones((1, len(codes))), xs, parts).items()}
        made = [curves(draw_weights(rng, k, min(chunk, n_boot - i))[:, codes], xs, parts) for i in range(0, n_boot, chunk)]
        return _long(xs, point, {q: np.concatenate([m[q] for m in made]) for q in point}, alpha)

    return _grouped(rows, by, run, _CURVE)


def _in_order(per: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """``per``, written, with ``_code``: the place of a row, from 0, in its group by ``key``; no task sorts a group alone."""
    at = per.repartitionByRange(*by, key).sortWithinPartitions(*by, key).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    at = saved(at, "in-order")
    pieces = at.groupBy(*by, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_lo"))  # a row per group and task
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return join_groups(at, pieces.drop("_n"), [*by, "_part"]).withColumn("_code", F.col("_before") + F.col("_at") - F.col("_lo")).drop("_part", "_at", "_lo", "_before")


def _least_draws(groups: DataFrame, by: Sequence[str], most: int, n_draw: int, seed: int, piece: int) -> DataFrame:
    """by, _draw, _code and _u of what may be the ``most`` smallest of each draw's k numbers.

    The numbers are those of one generator that fills (n_draw, k); a task jumps to its piece of a draw.
    """
    types = {f.name: f.dataType.simpleString() for f in groups.schema}
    head = "".join(f"`{c}` {types[c]}, " for c in by)
    cut = F.expr(f"int(ceil(_k / {piece}))")
    units = groups.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(n_draw - 1)))).withColumn("_piece", F.explode(F.sequence(F.lit(0), cut - 1)))
    spread_units = units.repartition(4 * groups.sparkSession.sparkContext.defaultParallelism, *by, "_draw", "_piece")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.to_dict("records"):
                k, lo = int(r["_k"]), int(r["_piece"]) * piece
                rng = np.random.default_rng(seed)
                rng.bit_generator.advance(int(r["_draw"]) * k + lo)
                u = rng.random(min(piece, k - lo))
                least = np.argpartition(u, most - 1)[:most] if most < len(u) else np.arange(len(u))
                yield pd.DataFrame({**{c: [r[c]] * len(least) for c in by}, "_draw": np.full(len(least), r["_draw"], np.int32), "_code": least.astype(np.int64) + lo, "_u": u[least]})

    return spread_units.mapInPandas(run, f"{head}_draw int, _code bigint, _u double")


def subsampled_sharpness(df: DataFrame, x: str, ok: str, ms: Sequence[int], n_draw: int = 400, seed: int = 1, by: Sequence[str] = (), item: str = "item_id", cluster: str = "cluster", log_x: bool = True, piece: int = 1 << 21) -> DataFrame:
    """Mean and deviation over draws of the largest chi when only m clusters are scored.

    A draw of m is the m smallest of a generator's numbers, one per cluster in the order of their first
    items. Tasks draw ``piece`` numbers at a time, and only the clusters that some draw takes meet: no
    task sees a group.
    """
    right = F.aggregate(ok, F.lit(1.0), lambda a, v: a * v.cast("double"))
    rows = align(df, x, F.col(ok).isNotNull(), by, item, log_x).select(*by, "_x", "_item", require(F.col(cluster).isNotNull(), f"an item has no {cluster}", F.col(cluster)).alias("_cluster"), right.alias("_right"))
    items = rows.groupBy(*by, "_item").agg(F.min_by("_cluster", "_x").alias("_cluster"), F.collect_list(F.struct("_x", "_right")).alias("_points"))  # a point per axis value
    sums = items.select(*by, "_item", "_cluster", F.inline("_points")).groupBy(*by, "_cluster", "_x").agg(F.sum("_right").alias("_s"), F.count("*").alias("_n"), F.min("_item").alias("_first"))
    per = sums.groupBy(*by, "_cluster").agg(F.min("_first").alias("_first"), F.collect_list(F.struct("_x", "_s", "_n")).alias("_points"))
    coded = _in_order(per, by, "_first")
    k = F.count("*")
    possible = F.when((k >= max(ms)) & (F.lit(min(ms)) >= 1), k).otherwise(F.raise_error(F.format_string(f"a subsample of {min(ms) if min(ms) < 1 else max(ms)} is not possible with %d clusters", k)))
    groups = coded.groupBy(*by).agg(possible.alias("_k"))
    drawn = _least_draws(groups, by, max(ms), n_draw, seed, piece)
    rank = F.row_number().over(Window.partitionBy(*by, "_draw").orderBy("_u", "_code"))
    taken = saved(drawn.withColumn("_rank", rank).where(F.col("_rank") <= max(ms)).drop("_u"), "taken-clusters")
    scored = join_groups(taken, coded.select(*by, "_code", "_points"), [*by, "_code"]).select(*by, "_draw", "_rank", F.inline("_points"))
    each = scored.withColumn("m", F.explode(F.array(*[F.lit(m) for m in ms]))).where("_rank <= m").groupBy(*by, "_draw", "m", "_x").agg((F.sum("_s") / F.sum("_n")).alias("_a"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for m in ms:
            a = pdf[pdf["m"] == m].pivot(index="_draw", columns="_x", values="_a").sort_index()
            s = gradient(a.columns.to_numpy(float), a.to_numpy(float), log_x).max(axis=1)
            out.append((m, float(s.mean()), float(s.std(ddof=1)), n_draw))
        return pd.DataFrame(out, columns=["m", "s_mean", "s_sd", "n_draw"])

    return _grouped(each, by, run, "m int, s_mean double, s_sd double, n_draw int")


def curve_caveats(curves: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """Caveats per group of a table of :func:`value_curves` or :func:`axis_curves` over k clusters."""
    from plumbline.operators.statistics import few_clusters

    c = F.col
    cross = c("quantity").startswith("crossing_")
    one = F.when(cross & c("point").isNull(), F.concat("quantity", F.lit(": the observed curve never reaches the level"))).when(
        cross & (c("censored") > CENSORED), F.format_string("%s: %s%% of replicates never cross", "quantity", F.bround(100 * c("censored"), 0).cast("int"))
    ).when((c("quantity") == "peak_at_edge") & (c("point") == 1), F.lit("chi peaks at an end of the grid, where it is a one-sided difference"))
    found = curves.groupBy(*by).agg(F.array_sort(F.collect_list(one)).alias("f"))
    return found.select(*by, F.concat_ws("; ", few_clusters(F.lit(k)), F.concat_ws("; ", "f")).alias("caveats"))
