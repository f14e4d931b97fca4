"""Statistics of judges: error rates, debiasing, agreement, error correlation and majorities.

The long frame has ``answer, cluster, judge, criterion, verdict, reference``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import number, ratio, require
from plumbline.operators.statistics import DRAWS, NORMAL, cluster_bootstrap, mcnemar, ratio_se

KEYS = ("answer", "criterion")


def binary(name: str) -> Column:
    v = number(name)
    return require(v.isin(0.0, 1.0), f"{name} must be 0 or 1 in every row", v)


def verdicts_long(judged: DataFrame, criteria: Sequence[str], source: DataFrame | None = None, reference: Mapping[str, str] | None = None, id_col: str = "item_id") -> DataFrame:
    """Melt columns ``v_<criterion>`` of ok rows; references come from named columns of ``source``."""
    ok = judged.where("status = 'ok'") if "status" in judged.columns else judged
    pairs = ", ".join(f"'{c}', double(v_{c})" for c in criteria)
    out = ok.selectExpr(f"{id_col} AS answer", "cluster", "judge", f"stack({len(criteria)}, {pairs}) AS (criterion, verdict)")
    named = {k: v for k, v in (reference or {}).items() if k in criteria}
    if source is None or not named:
        return out.withColumn("reference", F.lit(None).cast("double"))
    refs = source.selectExpr(f"{id_col} AS answer", f"stack({len(named)}, {', '.join(f"'{k}', double({v})" for k, v in named.items())}) AS (criterion, reference)")
    return out.join(refs, ["answer", "criterion"], "left").select("answer", "cluster", "judge", "criterion", "verdict", "reference")


def judge_error_rates(df: DataFrame, by: Sequence[str] = ("judge", "criterion"), verdict: str = "verdict", reference: str = "reference", cluster: str = "cluster") -> DataFrame:
    """Confusion counts, alpha, beta and lambda per group with cluster-robust errors."""
    v, y = binary(verdict), binary(reference)
    cells = {"tp": v * y, "fn": (1 - v) * y, "fp": v * (1 - y), "tn": (1 - v) * (1 - y)}
    rows = df.where(" AND ".join(f"{b} IS NOT NULL" for b in by)).select(*by, F.col(cluster).alias("cluster"), *[c.alias(n) for n, c in cells.items()])
    per = rows.groupBy(*by, "cluster").agg(*[F.sum(n).alias(n) for n in cells])
    c = F.col
    out = per.groupBy(*by).agg(
        *[F.sum(n).cast("bigint").alias(n) for n in cells], F.count("*").alias("k"),
        ratio_se(c("fp"), c("fp") + c("tn")).alias("se_alpha"), ratio_se(c("fn"), c("fn") + c("tp")).alias("se_beta"),
    )
    alpha, beta = ratio(c("fp"), c("fp") + c("tn")), ratio(c("fn"), c("fn") + c("tp"))
    return out.select(*by, *cells, (c("tp") + c("fn")).alias("n_pos"), (c("fp") + c("tn")).alias("n_neg"), "k", alpha.alias("alpha"), beta.alias("beta"), (1 - alpha - beta).alias("lam"), "se_alpha", "se_beta")


def debias(df: DataFrame, m: str = "m", se_m: str = "se_m", ci: float = 0.95) -> DataFrame:
    """``df`` (with alpha, beta and their errors) plus theta, its error and Wald interval; lambda <= 0 is refused."""
    c, z = F.col, NORMAL.inv_cdf(0.5 + ci / 2)
    lam = 1 - c("alpha") - c("beta")
    theta = (c(m) - c("alpha")) / c("_lam")
    var = (F.pow(c(se_m), 2) + F.pow((1 - c("theta")) * c("se_alpha"), 2) + F.pow(c("theta") * c("se_beta"), 2)) / c("_lam") ** 2
    out = df.withColumn("_lam", require(lam > 0, "the judge does not discriminate: lambda is not positive", lam)).withColumn("theta", theta)
    out = out.withColumn("se", F.sqrt(var)).withColumn("lo", c("theta") - z * c("se")).withColumn("hi", c("theta") + z * c("se"))
    return out.withColumn("lam", c("_lam")).withColumn("attenuation", c("_lam") ** 2).drop("_lam")


def debiased_mean(df: DataFrame, rates: DataFrame, calibration: DataFrame, verdict: str = "verdict", cluster: str = "cluster", n_boot: int = DRAWS, seed: int = 0) -> DataFrame:
    """Debiased pass rate of each judge and criterion of ``rates``; shared clusters are refused."""
    shared = df.select(cluster).join(calibration.select(cluster).distinct(), cluster, "left_semi").limit(1)
    if not shared.isEmpty():
        raise ValueError(f"cluster {shared.first()[0]!r} is in both the calibration and the scored set")
    boot = cluster_bootstrap(df, verdict, ["judge", "criterion"], cluster, n_boot, seed).select("judge", "criterion", F.col("point").alias("m"), F.col("se").alias("se_m"), "n_clusters", "n_rows")
    out = debias(boot.join(rates.select("judge", "criterion", "alpha", "beta", "se_alpha", "se_beta"), ["judge", "criterion"]))
    return out.select("judge", "criterion", "theta", "se", "lo", "hi", "lam", "attenuation", "m", "n_clusters", "n_rows")


def _unique(df: DataFrame, value: Column) -> DataFrame:
    """One row per answer, criterion and judge; repeats are refused."""
    one = require(F.count("*") == 1, "a judge has two rows for one answer and criterion", F.max("value"))
    return df.select(*KEYS, "judge", value.alias("value")).groupBy(*KEYS, "judge").agg(one.alias("value"))


def agreement(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    """Per criterion and pair of judges, over answers that both scored."""
    w = _unique(df.where(number(verdict).isNotNull()), binary(verdict))
    seen = w.select("criterion", "judge").distinct()
    pairs = seen.select("criterion", F.col("judge").alias("judge_1")).join(seen.select("criterion", F.col("judge").alias("judge_2")), "criterion").where("judge_1 < judge_2")
    a, b = (w.select(*KEYS, F.col("judge").alias(f"judge_{i}"), F.col("value").alias(f"v{i}")) for i in (1, 2))
    both = a.join(b, list(KEYS)).where("judge_1 < judge_2")
    c = F.col
    counts = both.groupBy("criterion", "judge_1", "judge_2").agg(
        F.count("*").alias("n"), F.avg((c("v1") == c("v2")).cast("double")).alias("agreement"), F.avg("v1").alias("pass_1"), F.avg("v2").alias("pass_2"),
        F.count_if((c("v1") == 1) & (c("v2") == 0)).alias("b"), F.count_if((c("v1") == 0) & (c("v2") == 1)).alias("c"),
    )
    out = pairs.join(counts, ["criterion", "judge_1", "judge_2"], "left").na.fill(0, ["n", "b", "c"])
    chance = c("pass_1") * c("pass_2") + (1 - c("pass_1")) * (1 - c("pass_2"))
    kappa = F.when(chance < 1, (c("agreement") - chance) / F.nullif(1 - chance, F.lit(0.0)))
    return out.select("criterion", "judge_1", "judge_2", "n", "agreement", kappa.alias("kappa"), "pass_1", "pass_2", "b", "c", mcnemar(c("b"), c("c")).alias("mcnemar_p"))


def error_correlation(df: DataFrame, verdict: str = "verdict", reference: str = "reference") -> DataFrame:
    """Per pair of judges: correlation of errors over answers that all judges scored; NULL if undefined."""
    e = _unique(df, (binary(verdict) != binary(reference)).cast("double"))
    judges = e.agg(F.count_distinct("judge").alias("j"))
    whole = e.groupBy(*KEYS).agg(F.count("*").alias("k")).crossJoin(F.broadcast(judges)).where("k = j").select(*KEYS)
    w = e.join(whole, list(KEYS))
    a, b = (w.select(*KEYS, F.col("judge").alias(f"judge_{i}"), F.col("value").alias(f"e{i}")) for i in (1, 2))
    both = a.join(b, list(KEYS)).where("judge_1 < judge_2").groupBy("judge_1", "judge_2")
    sx, sy = F.stddev_pop("e1"), F.stddev_pop("e2")
    rho = F.when((sx > 0) & (sy > 0), F.covar_pop("e1", "e2") / F.nullif(sx * sy, F.lit(0.0)))
    return both.agg(F.count("*").alias("n"), F.avg("e1").alias("rate_1"), F.avg("e2").alias("rate_2"), rho.alias("rho"))


def panel(pairs: DataFrame) -> DataFrame:
    """From :func:`error_correlation`: judges, mean correlation and effective number of judges."""
    c = F.col
    out = pairs.agg(F.count("*").alias("p"), F.count("rho").alias("known"), F.avg("rho").alias("rho_bar"), F.max("n").alias("n"))
    j = ((1 + F.sqrt(1 + 8 * c("p"))) / 2).cast("int")
    out = out.select("n", j.alias("n_judges"), F.when(c("known") == c("p"), c("rho_bar")).alias("rho_bar"))
    bound = 1 + (c("n_judges") - 1) * c("rho_bar")
    return out.withColumn("n_eff", F.when(bound <= 1e-12, float("inf")).otherwise(c("n_judges") / F.nullif(bound, F.lit(0.0))))


def majority(df: DataFrame, judges: Sequence[str], verdict: str = "verdict") -> DataFrame:
    """The verdict of an odd panel per answer and criterion, NULL and ``incomplete`` if a judge is missing."""
    different = set(judges)
    if len(different) < len(judges) or not len(judges) % 2:
        raise ValueError(f"a majority needs an odd number of different judges, not {list(judges)}")
    v = number(verdict)
    value = require(v.isNull() | v.isin(0.0, 1.0), f"{verdict} must be 0 or 1", v)
    judge = require(F.col("judge").isin(*judges), "a verdict is from outside the panel", F.col("judge"))
    extra = [c for c in ("cluster", "reference") if c in df.columns]
    rows = df.select(*KEYS, judge.alias("judge"), value.alias("v"), *extra)
    out = rows.groupBy(*KEYS).agg(
        F.count("v").alias("n_judges"), F.sum("v").alias("votes"), *[F.min_by(c, "judge").alias(c) for c in extra],
        require(F.count("*") == F.count_distinct("judge"), "a judge has two rows for one answer and criterion", F.lit(1)).alias("_one"),
    )
    done = F.col("n_judges") == len(judges)
    panel_ = F.when(done, (F.col("votes") > len(judges) / 2).cast("double"))
    return out.where("_one = 1").select(*KEYS, F.col("n_judges"), panel_.alias("panel"), F.when(done, "ok").otherwise("incomplete").alias("status"), *extra)


def judge_prompts(answers: DataFrame, rubric: str, instructions: str = "Grade the answer by each criterion.") -> DataFrame:
    """Answers (item_id, cluster, prompt, text, status) as items for a judge; the cluster is inherited."""
    fit = answers.where("status IN ('ok', 'unparsed')")
    text = require(F.trim("text") != "", "an answer has no text to judge", F.col("text"))
    return fit.select("item_id", "cluster", F.concat_ws("\n\n", F.lit(instructions), F.lit(rubric), F.concat(F.lit("Task: "), "prompt"), F.concat(F.lit("Answer: "), text)).alias("prompt"))


def verdict_tool(criteria: Mapping[str, str]) -> dict:
    """The tool that a judge has to call once: a boolean per criterion, described by its question."""
    if not criteria:
        raise ValueError("a verdict needs a criterion")
    odd = [c for c in criteria if not c.isidentifier() or c != c.lower()]
    if odd:
        raise ValueError(f"criteria are lower-case names, not {odd}")
    fields = {c: {"type": "boolean", "description": q} for c, q in criteria.items()}
    return {"name": "verdict", "description": "State for each criterion whether it is met.", "parameters": {"type": "object", "properties": fields, "required": list(criteria)}}


def run_panel(answers: DataFrame, judges: Mapping[str, object], criteria: Mapping[str, str]) -> DataFrame:
    """Put answers (answer, cluster, prompt) to each judge, a backend; long verdicts with their status.

    A judge's text holds its tool calls as JSON; what is no exact verdict is ``unparsed`` and has none.
    """
    from plumbline.plans.execution import call_backend

    out = None
    for name, backend in judges.items():
        said = call_backend(answers.select("answer", "cluster", "prompt").withColumn("judge", F.lit(name)), backend)
        v = parse_verdicts(F.col("text"), list(criteria))
        rows = said.withColumn("v", v).withColumn("status", F.when(F.col("error").isNotNull(), "error").when(F.col("v").isNull(), "unparsed").otherwise("ok"))
        pairs = ", ".join(f"'{c}', CAST(v.`{c}` AS DOUBLE)" for c in criteria)
        one = rows.selectExpr("answer", "cluster", "judge", "status", f"stack({len(criteria)}, {pairs}) AS (criterion, verdict)")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("a panel needs a judge")
    return out


def parse_verdicts(calls: Column, criteria: Sequence[str]) -> Column:
    """A struct of booleans from a JSON list of tool calls, NULL unless it is one exact ``verdict`` call.

    ``calls`` is ``[{"name": ..., "arguments": {...}}]``; keys must be the criteria and values booleans.
    """
    parsed = F.from_json(calls, "array<struct<name:string,arguments:string>>")
    call = F.get(parsed, F.lit(0))
    args = F.from_json(call["arguments"], "map<string,string>")
    exact = (F.size(parsed) == 1) & (call["name"] == "verdict") & (F.size(args) == len(criteria))
    for c in criteria:
        exact &= F.coalesce(F.try_element_at(args, F.lit(c)).isin("true", "false"), F.lit(False))
    return F.when(exact, F.struct(*[(F.try_element_at(args, F.lit(c)) == "true").alias(c) for c in criteria]))


def calibration_items(df: DataFrame, answer: str = "answer", number_: str = "gold") -> DataFrame:
    """Labelled answers by construction: the right number, written with separators, and wrong by one or two digits swapped."""

    def variants(batches):
        for pdf in batches:
            out = []
            for _, r in pdf.iterrows():
                g = int(r[number_])
                s = str(g)
                pairs = enumerate(zip(s, s[1:]))
                swapped = next((f"{s[:i]}{b}{a}{s[i + 2:]}" for i, (a, b) in pairs if a != b and (i or b != "0")), None)
                made = [("plain", s, 1.0), ("separated", f"{g:,}", 1.0), ("off_by_one", str(g + 1), 0.0)] + ([("swapped", swapped, 0.0)] if swapped else [])
                out += [(r[answer], name, text, label) for name, text, label in made]
            yield pd.DataFrame(out, columns=["answer", "variant", "text", "reference"])

    return df.select(answer, number_).mapInPandas(variants, f"answer {df.schema[answer].dataType.simpleString()}, variant string, text string, reference double")
