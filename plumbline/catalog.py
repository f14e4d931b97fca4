"""Queries over the driver's tables, each beside the DuckDB statement for the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import graders as G
from plumbline.functions import hashed_sql as H
from plumbline.functions.text import json_path, normalize
from plumbline.operators import accounting as A
from plumbline.operators import contamination as N
from plumbline.operators import curves as C
from plumbline.operators import events as E
from plumbline.operators import floors as L
from plumbline.operators import judges as V
from plumbline.operators import retrieval as Q
from plumbline.operators import statistics as S
from plumbline.plans import grid as P
from plumbline.plans.identity import shard_of, with_unit_ids
from plumbline.sources import jsonl
from plumbline.sources.tables import spread
from plumbline.streaming import live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its statement where SQL has one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


# == accounting ==

LABEL_STATUS = "CASE WHEN toxic = 1 AND quality = 0 THEN 'error' WHEN toxic = 1 THEN 'truncated' WHEN quality = 0 THEN 'unparsed' ELSE 'ok' END"


def label_rows(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return table(spark, sf, "labels").join(docs, "doc_id").selectExpr("doc_id AS unit_id", "lang", f"{LABEL_STATUS} AS status", "CAST(NULL AS STRING) AS error")


@query(f"""WITH rows_ AS (SELECT l.doc_id AS unit_id, d.lang, {LABEL_STATUS} AS status FROM labels l JOIN documents d USING (doc_id)),
plan AS (SELECT doc_id AS unit_id, lang FROM documents),
worst AS (SELECT unit_id, max(CASE status WHEN 'ok' THEN 0 WHEN 'unparsed' THEN 1 WHEN 'truncated' THEN 2 WHEN 'tool_error' THEN 3 ELSE 4 END) AS r FROM rows_ GROUP BY 1),
p AS (SELECT lang, count(*) AS n_planned, count(*) FILTER (r = 0) AS n_completed, count(*) FILTER (r = 4) AS n_err, count(*) FILTER (r = 3) AS n_tool_error,
  count(*) FILTER (r = 2) AS n_truncated, count(*) FILTER (r = 1) AS n_unparsed, count(*) FILTER (r IS NULL) AS n_missing FROM plan LEFT JOIN worst USING (unit_id) GROUP BY 1),
n AS (SELECT lang, count(*) AS n_rows FROM rows_ GROUP BY 1)
SELECT lang, n_planned, coalesce(n_rows, 0) AS n_rows, n_completed, n_err, n_tool_error, n_truncated, n_unparsed, n_missing, 0 AS n_unplanned,
  round(n_err / nullif(n_planned - n_missing, 0), 6) AS err_rate, round(n_missing / n_planned, 6) AS missing_rate, round(1 - n_completed / n_planned, 6) AS attrition_rate
FROM p LEFT JOIN n USING (lang)""")
def attrition_plan(spark, sf):
    plan = table(spark, sf, "documents").selectExpr("doc_id AS unit_id", "lang")
    return rounded(A.attrition(label_rows(spark, sf), ["lang"], plan))


@query(f"""SELECT lang, count(*) AS n_rows, count(*) FILTER (s = 'error') AS n_err, count(*) FILTER (s = 'tool_error') AS n_tool_error, count(*) FILTER (s = 'truncated') AS n_truncated,
  count(*) FILTER (s = 'unparsed') AS n_unparsed, round(count(*) FILTER (s = 'error') / count(*), 6) AS err_rate
FROM (SELECT d.lang, {LABEL_STATUS} AS s FROM labels l JOIN documents d USING (doc_id)) GROUP BY 1""")
def attrition_blind(spark, sf):
    return rounded(A.attrition(label_rows(spark, sf), ["lang"]))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS r FROM lineitem) WHERE r = 1""")
def latest_row_wins(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return A.latest_rows(rows, "l_orderkey", ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS r FROM conversations) WHERE r = 1""")
def manifest_first_wins(spark, sf):
    return A.first_rows(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", ("turn", "role", "text"))


@query("""SELECT CASE WHEN event_type = 'error' AND status NOT IN ('error', 'tool_error') THEN 'error' ELSE status END AS row_status, count(*) AS n
FROM (SELECT event_type, CASE WHEN event_id % 7 = 0 THEN 'tool_error' WHEN event_id % 5 = 0 THEN 'truncated' ELSE 'ok' END AS status FROM events) GROUP BY 1""")
def row_status(spark, sf):
    rows = table(spark, sf, "events").selectExpr("CASE WHEN event_type = 'error' THEN props END AS error", "CASE WHEN event_id % 7 = 0 THEN 'tool_error' WHEN event_id % 5 = 0 THEN 'truncated' END AS status")
    return rows.select(A.row_status(F.col("status"), F.col("error")).alias("row_status")).groupBy("row_status").agg(F.count("*").alias("n"))


@query("""WITH last AS (SELECT * FROM (SELECT l_orderkey, l_returnflag, l_linestatus, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1)
SELECT o_orderkey AS unit_id, CASE WHEN l.l_orderkey IS NULL THEN 'call' WHEN l_returnflag = 'R' THEN 'retry' WHEN l_linestatus IS DISTINCT FROM o_orderstatus THEN 'stale' WHEN l_linenumber % 2 = 0 THEN 'rescore' ELSE 'done' END AS decision
FROM orders LEFT JOIN last l ON o_orderkey = l.l_orderkey""")
def resume_decisions(spark, sf):
    rows = A.latest_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey", ("l_linenumber", "l_partkey", "l_suppkey"))
    latest = rows.selectExpr("l_orderkey AS unit_id", "CASE WHEN l_returnflag = 'R' THEN 'x' END AS error", "l_linestatus AS request_key", "CASE WHEN l_linenumber % 2 = 0 THEN 'v1' ELSE 'v2' END AS score_version")
    plan = table(spark, sf, "orders").selectExpr("o_orderkey AS unit_id", "o_orderstatus AS request_key")
    return P.resume(plan, latest, score_version="v2").select("unit_id", "decision")


@query("""SELECT r_name, n_name, k AS repeat FROM region, nation, range(3) t(k) WHERE NOT (r_name = 'ASIA' AND n_nationkey < 5)""")
def grid_exclude(spark, sf):
    axes = [table(spark, sf, "region").select("r_name"), table(spark, sf, "nation").select("n_name", "n_nationkey"), spark.range(3).withColumnRenamed("id", "repeat")]
    return P.grid(axes, (F.col("r_name") == "ASIA") & (F.col("n_nationkey") < 5)).select("r_name", "n_name", "repeat")


@query("""SELECT c_name, (('0x' || substr(sha256(c_name), 1, 16))::UBIGINT % 16)::INTEGER AS shard FROM customer""")
def shard_assign(spark, sf):
    return table(spark, sf, "customer").select("c_name", shard_of(F.col("c_name"), 16).alias("shard"))


@query(f"""SELECT n_planned, n_missing, n_bad, CASE WHEN n_missing > 0 THEN 'incomplete' WHEN n_bad = 0 THEN 'complete' ELSE 'complete_with_errors' END AS job_status FROM (
SELECT count(*) AS n_planned, count(*) FILTER (l.doc_id IS NULL) AS n_missing, count(*) FILTER ({LABEL_STATUS} NOT IN ('ok', 'truncated', 'unparsed') AND l.doc_id IS NOT NULL) AS n_bad FROM documents d LEFT JOIN labels l USING (doc_id))""")
def job_status(spark, sf):
    return A.job_status(table(spark, sf, "documents").selectExpr("doc_id AS unit_id"), label_rows(spark, sf))


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events""")
def item_mapping(spark, sf):
    return table(spark, sf, "events").select("event_id", json_path(F.col("props"), "k", "bigint").alias("k"))


@query()
def unit_ids(spark, sf):
    cells = table(spark, sf, "region").select(F.col("r_name").alias("cell_id"))
    items = table(spark, sf, "nation").select(F.col("n_name").alias("item_id"))
    return with_unit_ids(cells.crossJoin(items).withColumn("repeat", F.lit(0)))


# == statistics ==

PRICE = ("l_extendedprice", ["l_returnflag"], "l_orderkey")


@query("""SELECT l_returnflag, round(avg(m), 6) AS point, count(*) AS n_clusters, sum(n)::BIGINT AS n_rows, 0 AS n_excluded FROM (SELECT l_returnflag, l_orderkey, avg(l_extendedprice) AS m, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def cluster_mean(spark, sf):
    return rounded(S.cluster_mean(table(spark, sf, "lineitem"), *PRICE))


@query("""WITH c AS (SELECT l_returnflag AS f, l_orderkey, count(*) AS m, avg(l_extendedprice) AS mean, var_pop(l_extendedprice) * count(*) AS ss FROM lineitem GROUP BY 1, 2),
g AS (SELECT f, count(*) AS k, sum(m) AS n, sum(m * m) AS m2, sum(m * mean) / sum(m) AS grand, sum(ss) AS ssw FROM c GROUP BY 1),
b AS (SELECT f, sum(m * (mean - grand) * (mean - grand)) AS ssb FROM c JOIN g USING (f) GROUP BY 1),
i AS (SELECT f, k, n, (n - m2 / n) / (k - 1) AS m0, ssb / (k - 1) AS msb, ssw / nullif(n - k, 0) AS msw FROM g JOIN b USING (f)),
r AS (SELECT *, CASE WHEN (msb - msw) / m0 <= 0 THEN 0 ELSE (msb - msw) / m0 / ((msb - msw) / m0 + msw) END AS rho FROM i)
SELECT f AS l_returnflag, k, n::BIGINT AS "N", round(m0, 6) AS m0, round(msb, 2) AS ms_between, round(msw, 2) AS ms_within, round(rho, 6) AS rho, round(1 + (m0 - 1) * rho, 6) AS deff, round(n / (1 + (m0 - 1) * rho), 4) AS n_eff FROM r""")
def icc_effective_n(spark, sf):
    out = S.effective_n(table(spark, sf, "lineitem"), *PRICE)
    r = lambda c, d: F.round(c, d).alias(c)
    return out.select("l_returnflag", "k", "N", r("m0", 6), r("ms_between", 2), r("ms_within", 2), r("rho", 6), r("deff", 6), r("n_eff", 4))


@query()
def summarize_bootstrap(spark, sf):
    return S.summarize(table(spark, sf, "lineitem"), *PRICE, n_boot=1000)


ICC = """c AS (SELECT l_returnflag AS f, l_orderkey, count(*) AS m, avg(l_extendedprice) AS mean, var_pop(l_extendedprice) * count(*) AS ss FROM lineitem GROUP BY 1, 2),
g AS (SELECT f, count(*) AS k, sum(m) AS n, sum(m * m) AS m2, sum(m * mean) / sum(m) AS grand, sum(ss) AS ssw, avg(mean) AS point FROM c GROUP BY 1),
b AS (SELECT f, sum(m * (mean - grand) * (mean - grand)) AS ssb FROM c JOIN g USING (f) GROUP BY 1),
i AS (SELECT f, k, n, point, (n - m2 / n) / (k - 1) AS m0, ssb / (k - 1) AS msb, ssw / nullif(n - k, 0) AS msw FROM g JOIN b USING (f)),
rho AS (SELECT *, CASE WHEN (msb - msw) / m0 <= 0 THEN 0 ELSE (msb - msw) / m0 / ((msb - msw) / m0 + msw) END AS rho FROM i)"""


@query(f"""WITH {ICC}, keys AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), w AS {H.poisson_weights("keys", "k", 200)},
r AS (SELECT f, w.b, sum(w.w * c.mean) / nullif(sum(w.w), 0) AS m FROM c JOIN w ON c.l_orderkey = w.k GROUP BY 1, 2),
q AS (SELECT f, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, stddev_samp(m) AS se FROM r GROUP BY 1)
SELECT f AS l_returnflag, round(point, 4) AS point, round(lo, 4) AS lo, round(hi, 4) AS hi, round(se, 4) AS se, k AS n_clusters, n::BIGINT AS n_rows, 'poisson' AS ci_method, 0 AS n_excluded,
  round(rho, 4) AS rho, round(m0, 4) AS m0, round(1 + (m0 - 1) * rho, 4) AS deff, round(n / (1 + (m0 - 1) * rho), 4) AS n_eff, '' AS caveats FROM rho JOIN q USING (f)""")
def summarize_poisson(spark, sf):
    return rounded(S.summarize(table(spark, sf, "lineitem"), *PRICE, n_boot=200, engine="poisson"), 4)


HASH_BOOT = 200


@query(f"""WITH x AS (SELECT c_custkey AS cluster, c_acctbal AS v FROM customer), k AS (SELECT count(*) AS k FROM x),
w AS (SELECT b, cluster, v, ('0x' || substr(md5(b || '|' || cluster), 1, 8))::BIGINT AS h FROM x, range({HASH_BOOT}) t(b)),
r AS (SELECT b, sum(CASE WHEN h < 1579999999 THEN 0 WHEN h < 3159999999 THEN 1 ELSE 2 END * v) / nullif(sum(CASE WHEN h < 1579999999 THEN 0 WHEN h < 3159999999 THEN 1 ELSE 2 END), 0) AS m FROM w GROUP BY 1)
SELECT round((SELECT avg(v) FROM x), 4) AS point, round(quantile_cont(m, 0.025), 4) AS lo, round(quantile_cont(m, 0.975), 4) AS hi, round(stddev_samp(m), 4) AS se, (SELECT k FROM k) AS n_clusters FROM r""")
def bootstrap_hash_ci(spark, sf):
    """Weights 0, 1 or 2 of clusters by a hash that SQL has, percentile interval."""
    x = spread(table(spark, sf, "customer").select(F.col("c_custkey").alias("cluster"), F.col("c_acctbal").alias("v")), "cluster")
    reps = S.text_hash_sums(x, "v", HASH_BOOT).select((F.col("s") / F.nullif("w", F.lit(0.0))).alias("m"))
    q = reps.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.stddev_samp("m").alias("se"))
    point = x.agg(F.avg("v").alias("point"), F.count("*").alias("n_clusters"))
    return rounded(point.crossJoin(q).select("point", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"), "se", "n_clusters"), 4)


@query("""WITH c AS (SELECT user_id, avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view') AS d, count(*) AS m FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL GROUP BY 1)
SELECT round(avg(d), 6) AS point, count(d) AS n_clusters, coalesce(sum(m) FILTER (d IS NOT NULL), 0)::BIGINT AS n_rows, count(*) FILTER (d IS NULL) AS n_unpaired FROM c""")
def paired_difference(spark, sf):
    return rounded(S.paired_point(table(spark, sf, "events"), "value", "event_type", "click", "view", cluster="user_id"))


@query(f"""WITH c AS (SELECT user_id, avg(value) FILTER (event_type = 'click') - avg(value) FILTER (event_type = 'view') AS d, count(*) AS m FROM events WHERE event_type IN ('click', 'view') AND value IS NOT NULL GROUP BY 1),
own AS (SELECT * FROM c WHERE d IS NOT NULL), w AS {H.poisson_weights("(SELECT user_id FROM own)", "user_id", 1000)}, r AS (SELECT w.b, sum(w.w * d) / nullif(sum(w.w), 0) AS m FROM own JOIN w USING (user_id) GROUP BY 1)
SELECT round((SELECT avg(d) FROM own), 5) AS point, round(quantile_cont(m, 0.025), 5) AS lo, round(quantile_cont(m, 0.975), 5) AS hi, round(stddev_samp(m), 5) AS se, (SELECT count(*) FROM own) AS n_clusters, (SELECT sum(m) FROM own)::BIGINT AS n_rows,
  (SELECT count(*) FROM c WHERE d IS NULL) AS n_unpaired, round(least(1, greatest(2 * least(count(*) FILTER (m <= 0), count(*) FILTER (m >= 0)) / count(m), 1 / count(m))), 5) AS p FROM r""")
def paired_bootstrap_ci(spark, sf):
    return rounded(S.paired_bootstrap(table(spark, sf, "events"), "value", "event_type", "click", "view", cluster="user_id", n_boot=1000, engine="poisson"), 5)


@query("""WITH g AS (SELECT toxic, sum(quality) AS k, count(*) AS n FROM labels GROUP BY 1), z AS (SELECT toxic, k, n, k / n AS p, 1.959963984540054 * 1.959963984540054 / n AS z2n FROM g)
SELECT toxic, k::BIGINT AS k, n, round(greatest(0, (p + z2n / 2) / (1 + z2n) - 1.959963984540054 * sqrt(p * (1 - p) / n + z2n / (4 * n)) / (1 + z2n)), 6) AS lo,
  round(least(1, (p + z2n / 2) / (1 + z2n) + 1.959963984540054 * sqrt(p * (1 - p) / n + z2n / (4 * n)) / (1 + z2n)), 6) AS hi FROM z""")
def wilson(spark, sf):
    g = table(spark, sf, "labels").groupBy("toxic").agg(F.sum("quality").alias("k"), F.count("*").alias("n"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return rounded(g.withColumn("lo", lo).withColumn("hi", hi))


@query("""WITH d AS (SELECT lang, count(*) FILTER (n_chars > 1500 AND doc_id % 2 = 1) AS b, count(*) FILTER (n_chars <= 1500 AND doc_id % 2 = 0) AS c FROM documents GROUP BY 1),
t AS (SELECT lang, b, c, (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM range(least(b, c) + 1) r(i)) AS tail FROM d)
SELECT lang, b, c, CASE WHEN b + c = 0 THEN 1 ELSE round(least(1, 2 * tail), 6) END AS p FROM t""")
def mcnemar(spark, sf):
    long, even = F.col("n_chars") > 1500, F.col("doc_id") % 2 == 0
    g = table(spark, sf, "documents").groupBy("lang").agg(F.count_if(long & ~even).alias("b"), F.count_if(~long & even).alias("c"))
    return rounded(g.withColumn("p", S.mcnemar(F.col("b"), F.col("c"))))


P_VALUE = "(p_retailprice * 7919 - floor(p_retailprice * 7919 / 1000) * 1000) / 1000"
PART_P = f"SELECT p_partkey, p_brand, round(CASE WHEN p_partkey % 3 = 0 THEN {P_VALUE} / 500 ELSE {P_VALUE} END, 8) AS p FROM part"


@query(f"""WITH x AS ({PART_P}), r AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS m, count(*) OVER (PARTITION BY p_brand ORDER BY p) AS r FROM x),
t AS (SELECT *, max(CASE WHEN p <= r / m * 0.1 THEN p END) OVER (PARTITION BY p_brand) AS top FROM r) SELECT p_partkey, p_brand, p, coalesce(p <= top, false) AS reject FROM t""")
def bh_fdr(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    return S.benjamini_hochberg(spark.sql(PART_P), "p", 0.1, ["p_brand"])


@query(f"""WITH x AS ({PART_P}), r AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS m, row_number() OVER (PARTITION BY p_brand ORDER BY p) AS r FROM x),
t AS (SELECT *, min(CASE WHEN p > 0.1 / (m - r + 1) THEN p END) OVER (PARTITION BY p_brand) AS top FROM r) SELECT p_brand, count(*) FILTER (coalesce(p < top, true)) AS rejected, count(*) AS m FROM t GROUP BY 1""")
def holm_fwer(spark, sf):
    table(spark, sf, "part").createOrReplaceTempView("part")
    return S.holm(spark.sql(PART_P), "p", 0.1, ["p_brand"]).groupBy("p_brand").agg(F.count_if("reject").alias("rejected"), F.count("*").alias("m"))


@query("""WITH c AS (SELECT n_regionkey, c_nationkey, sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END) AS n, count(*) AS d FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
r AS (SELECT n_regionkey, sum(n) / sum(d) AS r, count(*) AS k, sum(d) AS t, count(*) FILTER (d > 0) AS kd FROM c GROUP BY 1)
SELECT n_regionkey, round(r, 6) AS ratio, CASE WHEN k >= 2 AND kd >= 2 THEN round((SELECT sqrt(k / (k - 1) * sum((c.n - r.r * c.d) * (c.n - r.r * c.d))) / t FROM c WHERE c.n_regionkey = r.n_regionkey), 4) END AS se FROM r""")
def ratio_se(spark, sf):
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    per = rows.groupBy("n_regionkey", "c_nationkey").agg(F.sum(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(0.0)).alias("n"), F.count("*").alias("d"))
    return per.groupBy("n_regionkey").agg(F.round(F.sum("n") / F.sum("d"), 6).alias("ratio"), F.round(S.ratio_se(F.col("n"), F.col("d")), 4).alias("se"))


# == judges ==

VERDICTS = """verdicts AS (SELECT d.doc_id AS answer, d.source AS cluster, j.judge, 'quality' AS criterion,
  CASE j.judge WHEN 'length' THEN (n_chars > 1000)::INT WHEN 'lang' THEN (lang = 'en')::INT ELSE (NOT (contains(text, '!!') OR contains(text, '$$')))::INT END::DOUBLE AS verdict, quality::DOUBLE AS reference
  FROM documents d JOIN labels l USING (doc_id), (VALUES ('length'), ('lang'), ('plain')) j(judge))"""


def judged(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return wide.selectExpr("doc_id AS answer", "source AS cluster", "quality", "stack(3, 'length', int(n_chars > 1000), 'lang', int(lang = 'en'), 'plain', int(NOT (contains(text, '!!') OR contains(text, '$$')))) AS (judge, v)").selectExpr("answer", "cluster", "judge", "'quality' AS criterion", "double(v) AS verdict", "double(quality) AS reference")


@query(f"WITH {VERDICTS} SELECT * FROM verdicts")
def verdicts_long(spark, sf):
    wide = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("item_id", F.col("doc_id")).withColumn("cluster", F.col("source"))
    each = {"length": F.col("n_chars") > 1000, "lang": F.col("lang") == "en", "plain": ~(F.col("text").contains("!!") | F.col("text").contains("$$"))}
    out = None
    for judge, test in each.items():
        rows = wide.withColumn("judge", F.lit(judge)).withColumn("v_quality", test.cast("double"))
        one = V.verdicts_long(rows, ["quality"], table(spark, sf, "labels").withColumnRenamed("doc_id", "item_id"), {"quality": "quality"})
        out = one if out is None else out.unionByName(one)
    return out


RATES = f"""{VERDICTS}, c AS (SELECT judge, criterion, cluster, sum(verdict * reference) AS tp, sum((1 - verdict) * reference) AS fn, sum(verdict * (1 - reference)) AS fp, sum((1 - verdict) * (1 - reference)) AS tn FROM verdicts GROUP BY 1, 2, 3),
g AS (SELECT judge, criterion, sum(tp) AS tp, sum(fn) AS fn, sum(fp) AS fp, sum(tn) AS tn, count(*) AS k, count(*) FILTER (fp + tn > 0) AS kn, count(*) FILTER (fn + tp > 0) AS kp FROM c GROUP BY 1, 2),
e AS (SELECT g.*, (SELECT sqrt(g.k / (g.k - 1) * sum((c.fp - g.fp / (g.fp + g.tn) * (c.fp + c.tn)) ** 2)) / (g.fp + g.tn) FROM c WHERE c.judge = g.judge) AS sa,
  (SELECT sqrt(g.k / (g.k - 1) * sum((c.fn - g.fn / (g.fn + g.tp) * (c.fn + c.tp)) ** 2)) / (g.fn + g.tp) FROM c WHERE c.judge = g.judge) AS sb FROM g),
rates AS (SELECT judge, criterion, tp::BIGINT AS tp, fn::BIGINT AS fn, fp::BIGINT AS fp, tn::BIGINT AS tn, (tp + fn)::BIGINT AS n_pos, (fp + tn)::BIGINT AS n_neg, k, fp / nullif(fp + tn, 0) AS alpha, fn / nullif(fn + tp, 0) AS beta,
  1 - fp / nullif(fp + tn, 0) - fn / nullif(fn + tp, 0) AS lam, CASE WHEN k >= 2 AND kn >= 2 THEN sa END AS se_alpha, CASE WHEN k >= 2 AND kp >= 2 THEN sb END AS se_beta FROM e)"""


@query(f"WITH {RATES} SELECT judge, criterion, tp, fn, fp, tn, n_pos, n_neg, k, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(lam, 6) AS lam, round(se_alpha, 5) AS se_alpha, round(se_beta, 5) AS se_beta FROM rates")
def judge_error_rates(spark, sf):
    out = V.judge_error_rates(judged(spark, sf))
    return out.select(*out.columns[:-5], *[F.round(c, d).alias(c) for c, d in (("alpha", 6), ("beta", 6), ("lam", 6), ("se_alpha", 5), ("se_beta", 5))])


@query(f"""WITH {RATES}, m AS (SELECT judge, avg(v) AS m FROM (SELECT judge, cluster, avg(verdict) AS v FROM verdicts GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT judge, m, lam, (m - alpha) / lam AS theta, alpha, se_alpha, beta, se_beta FROM rates JOIN m USING (judge) WHERE lam > 0),
v AS (SELECT *, sqrt(0.0004 + pow((1 - theta) * se_alpha, 2) + pow(theta * se_beta, 2)) / lam AS se FROM t)
SELECT judge, round(m, 6) AS m, round(lam, 6) AS lam, round(lam * lam, 6) AS attenuation, round(theta, 4) AS theta, round(se, 3) AS se FROM v""")
def debias(spark, sf):
    rates = V.judge_error_rates(judged(spark, sf)).where("lam > 0")
    mean = S.cluster_mean(judged(spark, sf), "verdict", ["judge"]).select("judge", F.col("point").alias("m"), F.lit(0.02).alias("se_m"))
    out = V.debias(rates.join(mean, "judge"))
    return out.select("judge", *[F.round(c, d).alias(c) for c, d in (("m", 6), ("lam", 6), ("attenuation", 6), ("theta", 4), ("se", 3))])


PAIRS = f"""WITH {VERDICTS}, p AS (SELECT a.criterion, a.judge AS judge_1, b.judge AS judge_2, count(*) AS n, avg((a.verdict = b.verdict)::INT) AS agreement, avg(a.verdict) AS pass_1, avg(b.verdict) AS pass_2,
  count(*) FILTER (a.verdict = 1 AND b.verdict = 0) AS b, count(*) FILTER (a.verdict = 0 AND b.verdict = 1) AS c FROM verdicts a JOIN verdicts b USING (answer, criterion) WHERE a.judge < b.judge GROUP BY 1, 2, 3)"""


@query(f"""{PAIRS} SELECT criterion, judge_1, judge_2, n, round(agreement, 6) AS agreement, round((agreement - (pass_1 * pass_2 + (1 - pass_1) * (1 - pass_2))) / nullif(1 - (pass_1 * pass_2 + (1 - pass_1) * (1 - pass_2)), 0), 6) AS kappa,
  round(pass_1, 6) AS pass_1, round(pass_2, 6) AS pass_2, b, c, round(CASE WHEN b + c = 0 THEN 1 ELSE least(1, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM range(least(b, c) + 1) r(i))) END, 6) AS mcnemar_p FROM p""")
def judge_agreement(spark, sf):
    return rounded(V.agreement(judged(spark, sf)))


@query(f"""WITH {VERDICTS}, e AS (SELECT answer, judge, (verdict <> reference)::INT AS e FROM verdicts)
SELECT a.judge AS judge_1, b.judge AS judge_2, count(*) AS n, round(avg(a.e), 6) AS rate_1, round(avg(b.e), 6) AS rate_2,
  CASE WHEN stddev_pop(a.e) > 0 AND stddev_pop(b.e) > 0 THEN round(covar_pop(a.e, b.e) / (stddev_pop(a.e) * stddev_pop(b.e)), 6) END AS rho FROM e a JOIN e b USING (answer) WHERE a.judge < b.judge GROUP BY 1, 2""")
def error_correlation(spark, sf):
    return rounded(V.error_correlation(judged(spark, sf)))


@query(f"""WITH {VERDICTS} SELECT answer, criterion, count(verdict) AS n_judges, CASE WHEN count(verdict) = 3 THEN (sum(verdict) > 1.5)::INT::DOUBLE END AS panel, CASE WHEN count(verdict) = 3 THEN 'ok' ELSE 'incomplete' END AS status,
  any_value(cluster) AS cluster, any_value(reference) AS reference FROM (SELECT answer, criterion, cluster, reference, CASE WHEN NOT (judge = 'plain' AND answer % 10 = 0) THEN verdict END AS verdict FROM verdicts) GROUP BY 1, 2""")
def judge_majority(spark, sf):
    some = judged(spark, sf).withColumn("verdict", F.when(~((F.col("judge") == "plain") & (F.col("answer") % 10 == 0)), F.col("verdict")))
    return V.majority(some, ["length", "lang", "plain"])


# == floors ==

FLOORS = """p AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT max(n) AS top, sum(n * n) AS sq, sum(n) AS s, count(*) AS k FROM p),
f AS (SELECT unnest([{'floor': 'majority', 'value': top / s, 'derived_from': 'label marginal', 'o': 0}, {'floor': 'prior_matched', 'value': sq / s / s, 'derived_from': 'label marginal', 'o': 1}, {'floor': 'uniform', 'value': 1 / k, 'derived_from': 'class count', 'o': 2}, {'floor': 'stated', 'value': 0.55, 'derived_from': 'supplied', 'o': 3}], recursive := true) FROM t)"""


@query(f"WITH {FLOORS} SELECT floor, round(value, 6) AS value, 'rate' AS units, derived_from FROM f")
def floors(spark, sf):
    return rounded(L.floors(table(spark, sf, "documents"), "lang", custom={"stated": 0.55}).drop("ord"))


@query(f"WITH {FLOORS} SELECT floor AS binding_floor, round(value, 6) AS floor_value, 0.62 AS observed, round(0.62 - value, 6) AS headroom, 0.62 > value AS above_floor FROM f ORDER BY value DESC, o LIMIT 1")
def headroom(spark, sf):
    return rounded(L.headroom(0.62, L.floors(table(spark, sf, "documents"), "lang", custom={"stated": 0.55})))


# == retrieval ==

BENCH_K = 10


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """The stated queries: every benchmark item."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query"), "text")


def lexical(spark: SparkSession, sf: str, k: int) -> DataFrame:
    return Q.bm25_search(spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id"), asked(spark, sf), k)


BM25 = """WITH docs AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM docs), tf AS (SELECT doc_id, len, term, count(*) AS f FROM (SELECT doc_id, len(t) AS len, unnest(t) AS term FROM docs) GROUP BY 1, 2, 3),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT term, doc_id, ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len / mean)) AS weight FROM tf JOIN df USING (term), s),
q AS (SELECT query, term, count(*) AS q FROM (SELECT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark) GROUP BY 1, 2),
sc AS (SELECT query, doc_id, round(sum(weight * q), 9) AS score FROM w JOIN q USING (term) GROUP BY 1, 2),
ranked AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS pos, doc_id, score FROM sc WHERE score > 0)"""


@query(f"{BM25} SELECT query, pos, doc_id, round(score, 6) AS score FROM ranked WHERE pos <= {BENCH_K}")
def bm25_topk(spark, sf):
    return rounded(lexical(spark, sf, BENCH_K))


@query(f"""{BM25}, first AS (SELECT r.query, r.doc_id, r.score / ln(2 + n_chars) AS score FROM ranked r JOIN documents USING (doc_id) WHERE pos <= 50),
again AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc_id) AS pos, doc_id, score FROM first) SELECT query, pos, doc_id, round(score, 6) AS score FROM again WHERE pos <= 5""")
def rerank(spark, sf):
    first = lexical(spark, sf, 50).join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return rounded(Q.rerank(first, F.col("score") / F.log(2 + F.col("n_chars")), 5, 50))


def vectors(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and those of the stated queries: every id divisible by 100."""
    e = table(spark, sf, "embeddings")
    return spread(e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector")), "doc_id"), e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


COSINE = """WITH q AS (SELECT vec_id AS query, embedding AS a, label FROM embeddings WHERE vec_id % 100 = 0),
sc AS (SELECT query, vec_id AS doc_id, q.label = e.label AS is_gold, round(list_inner_product(a::DOUBLE[], embedding::DOUBLE[]) / sqrt(list_inner_product(a::DOUBLE[], a::DOUBLE[])) / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 9) AS score FROM q, embeddings e),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS pos FROM sc)"""


def cosines(spark: SparkSession, sf: str) -> DataFrame:
    return Q.dense_scores(*vectors(spark, sf)).withColumn("score", F.round("score", 9))


@query(f"{COSINE} SELECT query, pos, doc_id, round(score, 4) AS score FROM ranked WHERE pos <= 5")
def dense_exact_topk(spark, sf):
    return rounded(Q.dense_search(*vectors(spark, sf), k=5), 4)


@query("SELECT count(*) AS n_queries, true AS reached FROM embeddings WHERE vec_id % 100 = 0")
def ann_recall(spark, sf):
    """Whether the index, probed as its fit says, reaches a recall of 0.95 against exact search."""
    docs, queries = vectors(spark, sf)
    stored = table(spark, sf, "embeddings").selectExpr("vec_id AS doc_id", "embedding AS vector")  # in its own order: a sample is the same every time
    c = Q.ivf_fit(stored, 32)
    found = Q.ivf_search(Q.ivf_index(docs, c), c, queries, 10, Q.choose_nprobe(stored, c, 10))
    return Q.check_recall(found, Q.dense_search(docs, queries, 10), 10).select("n_queries", "reached")


def same_label(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "label")
    return q.join(e.select(F.col("vec_id").alias("doc_id"), "label"), "label").select("query", "doc_id")


@query(f"""{COSINE}, g AS (SELECT query, count(*) AS n FROM sc WHERE is_gold GROUP BY 1), h AS (SELECT query, min(pos) AS first, {", ".join(f"count(*) FILTER (pos <= {k}) AS n{k}, sum(1 / log2(pos + 1)) FILTER (pos <= {k}) AS d{k}" for k in (1, 5, 10))} FROM ranked WHERE is_gold AND pos <= 10 GROUP BY 1)
SELECT query, {", ".join(f"round(coalesce(n{k}, 0) / n, 6) AS \"recall@{k}\", (coalesce(n{k}, 0) > 0)::INT::DOUBLE AS \"hit@{k}\", round(coalesce(d{k}, 0) / (SELECT sum(1 / log2(i + 2)) FROM range(least({k}, n)) t(i)), 6) AS \"ndcg@{k}\"" for k in (1, 5, 10))}, round(coalesce(1 / first, 0), 6) AS rr
FROM g LEFT JOIN h USING (query)""")
def retrieval_metrics(spark, sf):
    return rounded(Q.rank_metrics(Q.dense_search(*vectors(spark, sf), k=10), same_label(spark, sf)))


def _control(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    """Gold: a few documents of each query by a rule on their ids. Best documents and gold are all that a control shows."""
    docs, queries = vectors(spark, sf)
    gold = queries.select("query").join(docs.where("doc_id < 500").select("doc_id"), F.expr("doc_id % 250 = query % 250 OR doc_id % 250 = (query + 7) % 250"))
    best = Q.dense_search(docs, queries, k=6 + 4).select("query", "doc_id", "score")
    own = gold.join(queries.withColumnRenamed("vector", "q"), "query").join(docs, "doc_id").select("query", "doc_id", F.round(Q.cosine(F.col("q"), F.col("vector")), 9).alias("score"))
    return rounded(Q.gold_control(best.union(own).groupBy("query", "doc_id").agg(F.max("score").alias("score")), gold, mode, 6), 4)


CONTROL = f"{COSINE}, m AS (SELECT query, doc_id, score, doc_id < 500 AND (doc_id % 250 = query % 250 OR doc_id % 250 = (query + 7) % 250) AS g FROM sc)"


@query(f"{COSINE} SELECT query, pos, doc_id, round(score, 4) AS score FROM ranked WHERE pos <= 6")
def gold_control_none(spark, sf):
    return _control(spark, sf, "none")


@query(f"{CONTROL} SELECT query, pos, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY g DESC, score DESC, doc_id) AS pos FROM m) WHERE pos <= 6")
def gold_control_oracle(spark, sf):
    return _control(spark, sf, "oracle")


@query(f"{CONTROL} SELECT query, pos, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS pos FROM m WHERE NOT g) WHERE pos <= 6")
def gold_control_removed(spark, sf):
    return _control(spark, sf, "removed")


@query(f"""{COSINE}, p AS (SELECT *, round(4.0 * score - ln(-ln((('0x' || substr(md5('5|' || query || '|' || doc_id || '|0'), 1, 8))::BIGINT + 0.5) / 4294967296.0)), 9) AS noisy FROM sc)
SELECT query, pos, doc_id, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY noisy DESC, doc_id) AS pos FROM p) WHERE pos <= 5""")
def sampled_retrieval(spark, sf):
    return rounded(Q.sampled_search(*vectors(spark, sf), 5, 4.0, 5), 4)


# == graders ==

PUNCT = "'!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~'"
NORM = f"trim(regexp_replace(translate(lower(text), {PUNCT}, ''), '\\s+', ' ', 'g'))"


def said(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "text")


@query(f"WITH n AS (SELECT conv_id, turn, {NORM} AS p FROM conversations) SELECT conv_id, turn, (p = split_part(p, ' ', 1))::INT::DOUBLE AS correct, length(p) AS size FROM n WHERE p <> ''")
def grade_exact(spark, sf):
    gold = F.split_part(normalize(F.col("text")), F.lit(" "), F.lit(1))
    g = said(spark, sf).withColumn("p", normalize(F.col("text"))).where("p <> ''").withColumn("g", G.exact(F.col("text"), gold))
    return g.select("conv_id", "turn", F.col("g.correct").alias("correct"), F.length("g.pred").alias("size"))


@query(f"WITH n AS (SELECT conv_id, turn, {NORM} AS p FROM conversations) SELECT conv_id, turn, (contains(p, 'the on') OR contains(p, 'un'))::INT::DOUBLE AS correct FROM n WHERE p <> ''")
def grade_contains(spark, sf):
    g = said(spark, sf).withColumn("g", G.contains(F.col("text"), F.array(F.lit("The on!"), F.lit("un")), many=True))
    return g.where("g IS NOT NULL").select("conv_id", "turn", F.col("g.correct").alias("correct"))


@query("""WITH t AS (SELECT event_id, 'about ' || (event_id % 50) || ' or ' || (event_id % 7 * 1000 + 5) || '.5 units' AS s FROM events)
SELECT event_id, (abs(event_id % 7 * 1000 + 5.5 - 3000) <= 150)::INT::DOUBLE AS correct, event_id % 7 * 1000 + 5.5 AS pred, abs(event_id % 7 * 1000 + 5.5 - 3000) AS abs_err FROM t""")
def grade_numeric(spark, sf):
    text = F.concat(F.lit("about "), F.expr("event_id % 50"), F.lit(" or "), F.format_number(F.expr("event_id % 7 * 1000 + 5"), 0), F.lit(".5 units"))
    return table(spark, sf, "events").select("event_id", G.numeric(text, F.lit(3000.0), rel=0.05).alias("g")).select("event_id", "g.*")


@query("SELECT event_id, (event_id % 4 = 1)::INT::DOUBLE AS correct, substr('ABCD', (event_id % 4 + 1)::INT, 1) AS pred FROM events WHERE event_id % 5 <> 0")
def grade_choice(spark, sf):
    letter = F.substring(F.lit("ABCD"), F.expr("int(event_id % 4 + 1)"), F.lit(1))
    text = F.when(F.expr("event_id % 5 = 0"), "no letter here").when(F.expr("event_id % 2 = 0"), F.concat(F.lit("The answer is ("), letter, F.lit("), I think."))).otherwise(F.concat(letter, F.lit(" it is")))
    g = table(spark, sf, "events").select("event_id", G.choice(text, F.lit("B")).alias("g"))
    return g.where("g IS NOT NULL").select("event_id", "g.*")


@query("SELECT event_id, (event_id % 3 = 1)::INT::DOUBLE AS correct, CASE event_id % 3 WHEN 1 THEN 'yes' ELSE 'no' END AS pred FROM events WHERE event_id % 3 > 0")
def grade_yes_no(spark, sf):
    text = F.expr("CASE event_id % 3 WHEN 0 THEN 'Yes or no?' WHEN 1 THEN 'Well, YES.' ELSE 'no; know' END")
    g = table(spark, sf, "events").select("event_id", G.yes_no(text, F.lit("Yes")).alias("g"))
    return g.where("g IS NOT NULL").select("event_id", "g.*")


@query("""WITH s AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), 'th[a-z]')) AS f, ['tha', 'the', 'thi'] AS g FROM documents)
SELECT doc_id, (len(list_intersect(f, g)) = len(f) AND len(f) = 3)::INT::DOUBLE AS correct, round(len(list_intersect(f, g)) / len(f), 6) AS precision, round(len(list_intersect(f, g)) / 3, 6) AS recall,
  round(2 * len(list_intersect(f, g)) / (len(f) + 3), 6) AS f1, len(f) AS n_pred FROM s WHERE len(f) > 0""")
def grade_set_f1(spark, sf):
    gold = F.array(F.lit("tha"), F.lit("the"), F.lit("thi"))
    g = table(spark, sf, "documents").select("doc_id", G.set_f1(F.lower("text"), gold, "th[a-z]").alias("g"))
    return rounded(g.where("g IS NOT NULL").select("doc_id", "g.*"))


ABSTAINING = "CASE event_id % 3 WHEN 0 THEN 'It is not  mentioned here' WHEN 1 THEN 'It is 5' ELSE 'I can''t find it: 5' END"


@query("SELECT event_id, (event_id % 3 <> 1)::INT::DOUBLE AS correct, (event_id % 3 <> 1)::INT::DOUBLE AS abstained, (event_id % 3 = 1)::INT::DOUBLE AS hallucinated FROM events")
def grade_abstain(spark, sf):
    return table(spark, sf, "events").select("event_id", G.abstain(F.expr(ABSTAINING.replace("''", "\\'"))).alias("g")).select("event_id", "g.*")


@query("SELECT event_id, (event_id % 3 = 1)::INT::DOUBLE AS correct, 0.0 AS wrong, (event_id % 3 <> 1)::INT::DOUBLE AS abstained FROM events")
def grade_or_abstain(spark, sf):
    g = G.grade({"name": "numeric", "abstain": True}, F.expr(ABSTAINING.replace("''", "\\'")), F.lit(5.0))
    return table(spark, sf, "events").select("event_id", g.alias("g")).select("event_id", "g.*")


@query("SELECT event_id, (event_type = 'click')::INT::DOUBLE AS correct, event_type AS pred FROM events WHERE event_id % 4 > 0")
def grade_label(spark, sf):
    text = F.expr("CASE WHEN event_id % 4 = 0 THEN 'a click or a view' ELSE concat('It was a ', upper(event_type), '!') END")
    g = table(spark, sf, "events").select("event_id", G.label(text, F.lit("click"), ["view", "signup", "purchase", "click", "error"]).alias("g"))
    return g.where("g IS NOT NULL").select("event_id", "g.*")


# == contamination ==

WORD_GRAMS = """c AS (SELECT doc_id AS name, list_distinct(list_transform(range(1, greatest(1, len(w) - 6)), lambda i: array_to_string(w[i : i + 7], ' '))) AS g FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents) WHERE len(w) >= 8),
r AS (SELECT DISTINCT unnest(list_transform(range(1, greatest(1, len(w) - 6)), lambda i: array_to_string(w[i : i + 7], ' '))) AS g FROM (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark) WHERE len(w) >= 8)"""


@query(f"""WITH {WORD_GRAMS}, e AS (SELECT name, unnest(g) AS g FROM c), o AS (SELECT name, count(r.g) / count(*) AS overlap FROM e LEFT JOIN r USING (g) GROUP BY 1)
SELECT doc_id AS name, round(overlap, 6) AS overlap FROM documents LEFT JOIN o ON doc_id = name""")
def ngram_overlap(spark, sf):
    words = lambda t, k: spread(table(spark, sf, t).select(k, "text"), k).select(F.col(k).alias("name"), Q.tokens(F.col("text")).alias("seq"))
    return rounded(N.ngram_overlap(words("documents", "doc_id"), words("benchmark", "item_id"), 8, text=False))


def whole_items(spark: SparkSession, sf: str) -> int:
    """A cap that no match with a benchmark item reaches; 64, the operators' own, at least."""
    longest = table(spark, sf, "benchmark").agg(F.max(F.size(Q.tokens(F.col("text"))))).first()[0]
    return max(64, (longest or 0) + 1)


def islands(mine: str, theirs: str) -> str:
    """Longest shared runs of words between rows (name, w) of two tables, by runs along diagonals."""
    return f"""(SELECT name, max(n) AS longest FROM (SELECT name, other, i - j AS d, i - row_number() OVER (PARTITION BY name, other, i - j ORDER BY i) AS run, count(*) OVER (PARTITION BY name, other, i - j, i - r) AS n FROM (
  SELECT a.name, b.name AS other, a.i, b.i AS j, row_number() OVER (PARTITION BY a.name, b.name, a.i - b.i ORDER BY a.i) AS r FROM (SELECT name, w, unnest(range(len(w))) AS i FROM {mine}) a JOIN (SELECT name, w, unnest(range(len(w))) AS i FROM {theirs}) b ON a.w[a.i + 1] = b.w[b.i + 1])) GROUP BY 1)"""


TOKENS_OF = "regexp_extract_all(lower(text), '[a-z0-9]+')"


@query(f"""WITH c AS (SELECT doc_id AS name, {TOKENS_OF} AS w FROM documents), r AS (SELECT item_id AS name, {TOKENS_OF} AS w FROM benchmark), cap AS (SELECT greatest(64, max(len(w)) + 1) AS cap FROM r)
SELECT c.name, coalesce(longest, 0)::INT AS longest_match, coalesce(longest, 0) >= cap AS capped FROM c LEFT JOIN {islands("c", "r")} m USING (name), cap""")
def longest_match(spark, sf):
    words = lambda t, k: spread(table(spark, sf, t).select(k, "text"), k).select(F.col(k).alias("name"), Q.tokens(F.col("text")).alias("seq"))
    return N.longest_match(words("documents", "doc_id"), words("benchmark", "item_id"), whole_items(spark, sf), text=False)


def overlap_sql(n: int) -> str:
    gram = f"unnest(list_distinct(list_transform(range(1, greatest(1, len(w) - {n - 2})), lambda i: array_to_string(w[i : i + {n - 1}], ' '))))"
    return f"(SELECT name, count(g2) / count(*) AS o FROM (SELECT name, {gram} AS g FROM c WHERE len(w) >= {n}) LEFT JOIN (SELECT DISTINCT {gram} AS g2 FROM r WHERE len(w) >= {n}) ON g = g2 GROUP BY 1)"


@query(f"""WITH c AS (SELECT item_id::VARCHAR AS name, {TOKENS_OF} AS w FROM benchmark UNION ALL SELECT 'control', {TOKENS_OF} FROM documents WHERE doc_id = 1), r AS (SELECT doc_id AS name, {TOKENS_OF} AS w FROM documents),
cap AS (SELECT greatest(64, max(len(w)) + 1) AS cap FROM c WHERE name <> 'control'),
f AS (SELECT c.name, len(w) AS length, name = 'control' AS is_control, x.o AS o4, y.o AS o8, coalesce(least(m.longest, cap), 0)::INT AS lm, coalesce(m.longest, 0) >= cap AS capped FROM c LEFT JOIN {overlap_sql(4)} x USING (name) LEFT JOIN {overlap_sql(8)} y USING (name) LEFT JOIN {islands("c", "r")} m USING (name), cap)
SELECT f.name, f.length::INT AS length, f.is_control, round(f.o4, 6) AS overlap_4, round(f.o8, 6) AS overlap_8, f.lm AS longest_match, f.capped, round(f.o4 - k.o4, 6) AS overlap_4_excess, round(f.o8 - k.o8, 6) AS overlap_8_excess, f.lm - k.lm AS longest_match_excess
FROM f, (SELECT * FROM f WHERE is_control) k""")
def contamination_report(spark, sf):
    docs = table(spark, sf, "documents")
    words = lambda d, k: d.select(k.alias("name"), Q.tokens(F.col("text")).alias("seq"))
    control = docs.where("doc_id = 1").select(Q.tokens(F.col("text")).alias("seq"))
    return rounded(N.contamination_report(words(table(spark, sf, "benchmark"), F.col("item_id").cast("string")), words(spread(docs.select("doc_id", "text"), "doc_id"), F.col("doc_id")), control, (4, 8), whole_items(spark, sf), text=False))


# == curves ==


@query("""SELECT vec_id, label, (i - 1)::INTEGER AS position, round(embedding[i]::DOUBLE, 6) AS v, embedding[i] > 0 AS positive FROM embeddings, range(1, 65) t(i)""")
def explode_tokens(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("v"), F.transform("embedding", lambda x: x > 0).alias("positive"))
    return C.explode_tokens(e, ["v", "positive"])


CURVE = """WITH x AS (SELECT l_suppkey AS item, l_linenumber AS x, avg(l_quantity) AS v FROM lineitem GROUP BY 1, 2), nx AS (SELECT count(DISTINCT x) AS n FROM x),
whole AS (SELECT item FROM x GROUP BY 1 HAVING count(*) = (SELECT n FROM nx)), m AS (SELECT x::DOUBLE AS x, count(*) AS n, avg(v) AS mean FROM x SEMI JOIN whole USING (item) GROUP BY 1),
h AS (SELECT *, ln(x) - lag(ln(x)) OVER w AS a, lead(ln(x)) OVER w - ln(x) AS b, lag(mean) OVER w AS p, lead(mean) OVER w AS q FROM m WINDOW w AS (ORDER BY x)),
c AS (SELECT x, n, mean, CASE WHEN a IS NULL THEN (q - mean) / b WHEN b IS NULL THEN (mean - p) / a ELSE (a * a * q + (b * b - a * a) * mean - b * b * p) / (a * b * (a + b)) END AS chi FROM h)"""


def line_values(spark: SparkSession, sf: str) -> DataFrame:
    """The mean quantity of each supplier, the item, along line numbers, the axis."""
    rows = table(spark, sf, "lineitem")
    return rows.groupBy(F.col("l_suppkey").alias("item_id"), F.col("l_linenumber").alias("x")).agg(F.avg("l_quantity").alias("v")).withColumn("cluster", F.col("item_id"))


def line_curve(spark: SparkSession, sf: str) -> DataFrame:
    return C.value_curve(line_values(spark, sf), "x", "v")


@query(f"{CURVE} SELECT x, n, round(mean, 6) AS mean, round(chi, 6) AS chi FROM c")
def value_curve_points(spark, sf):
    return rounded(line_curve(spark, sf))


@query(f"{CURVE} SELECT first(x ORDER BY chi DESC, x) AS peak_x, round(max(chi), 6) AS peak_chi, first(x ORDER BY chi DESC, x) IN (min(x), max(x)) AS peak_at_edge FROM c")
def peak(spark, sf):
    return rounded(C.peak(line_curve(spark, sf)))


@query(f"""{CURVE}, l AS (SELECT avg(mean) AS level FROM (SELECT mean FROM m WHERE x IN (1, 2))), d AS (SELECT x, ln(x) AS u, mean - (SELECT round(level, 3) FROM l) AS y, lead(ln(x)) OVER (ORDER BY x) AS u1, lead(mean) OVER (ORDER BY x) - (SELECT round(level, 3) FROM l) AS y1 FROM m),
t AS (SELECT x, CASE WHEN y = 0 THEN u WHEN y * y1 < 0 THEN u + (u1 - u) * (-y) / (y1 - y) END AS u FROM d) SELECT round(exp(first(u ORDER BY x)), 4) AS crossing FROM t WHERE u IS NOT NULL""")
def crossing(spark, sf):
    curve = line_curve(spark, sf)
    level = curve.where("x IN (1, 2)").agg(F.round(F.avg("mean"), 3)).first()[0]
    return rounded(C.crossing(curve, "mean", level), 4)


CURVE_DRAWS, LEVEL = 200, 25.5


def draws_of(keys: str, column: str) -> str:
    """Draw -1 with weight 1 and the hashed draws."""
    return f"(SELECT {column}, -1 AS b, 1 AS w FROM {keys} UNION ALL SELECT {column}, b, w FROM {H.poisson_weights(keys, column, CURVE_DRAWS)})"


def gradient_sql(y: str, source: str, keep: str = "") -> str:
    """``source`` (b, x, ...) with chi of ``y`` over ln(x)."""
    return f"""(SELECT *, CASE WHEN h1 IS NULL THEN (q - {y}) / h2 WHEN h2 IS NULL THEN ({y} - p) / h1 ELSE (h1 * h1 * q + (h2 * h2 - h1 * h1) * {y} - h2 * h2 * p) / (h1 * h2 * (h1 + h2)) END AS chi_{y} FROM (
  SELECT *, ln(x) - lag(ln(x)) OVER (PARTITION BY b ORDER BY x) AS h1, lead(ln(x)) OVER (PARTITION BY b ORDER BY x) - ln(x) AS h2, lag({y}) OVER (PARTITION BY b ORDER BY x) AS p, lead({y}) OVER (PARTITION BY b ORDER BY x) AS q FROM {source}))"""


SUMMED = """SELECT quantity, x, round(max(v) FILTER (b < 0), 5) AS point, round(quantile_cont(v, 0.025) FILTER (b >= 0), 5) AS lo, round(quantile_cont(v, 0.975) FILTER (b >= 0), 5) AS hi, round(1 - count(v) FILTER (b >= 0) / count(*) FILTER (b >= 0), 5) AS censored FROM long GROUP BY 1, 2"""


@query(f"""{CURVE.partition(", m AS (SELECT x::DOUBLE")[0]}, rows_ AS (SELECT * FROM x SEMI JOIN whole USING (item)), keys AS (SELECT DISTINCT item FROM rows_), w AS {draws_of("keys", "item")},
m AS (SELECT b, x::DOUBLE AS x, sum(w * v) / nullif(sum(w), 0) AS mean FROM rows_ JOIN w USING (item) GROUP BY 1, 2), c AS {gradient_sql("mean", "m")},
top AS (SELECT b, max(chi_mean) AS chi, first(x ORDER BY chi_mean DESC, x) AS best, min(x) AS a, max(x) AS z FROM c GROUP BY 1),
d AS (SELECT b, x, ln(x) AS u, mean - {LEVEL} AS y, lead(ln(x)) OVER (PARTITION BY b ORDER BY x) AS u1, lead(mean) OVER (PARTITION BY b ORDER BY x) - {LEVEL} AS y1 FROM m),
t AS (SELECT b, x, CASE WHEN y = 0 THEN u WHEN y * y1 < 0 THEN u + (u1 - u) * (-y) / (y1 - y) END AS u FROM d), cross_ AS (SELECT b, exp(first(u ORDER BY x) FILTER (u IS NOT NULL)) AS v FROM t GROUP BY 1),
long AS (SELECT b, x, 'mean' AS quantity, mean AS v FROM c UNION ALL SELECT b, x, 'chi', chi_mean FROM c UNION ALL SELECT b, NULL, 'peak_chi', chi FROM top UNION ALL SELECT b, NULL, 'peak_x', best FROM top
  UNION ALL SELECT b, NULL, 'peak_at_edge', (best IN (a, z))::INT FROM top UNION ALL SELECT b, NULL, 'crossing_{LEVEL:g}', v FROM cross_) {SUMMED}""")
def value_curve_ci(spark, sf):
    return rounded(C.value_curves(line_values(spark, sf), "x", "v", levels=[LEVEL], n_boot=CURVE_DRAWS, engine="poisson"), 5)


TOKENS_SQL = """rows_ AS (SELECT x, l_orderkey AS item, list(ok ORDER BY l_linenumber, l_partkey, l_suppkey, ok) AS ok FROM (SELECT (l_quantity > 25)::INT AS ok, CASE WHEN l_returnflag = 'N' THEN 2 ELSE 1 END AS x, * FROM lineitem) GROUP BY 1, 2),
whole AS (SELECT item FROM rows_ GROUP BY 1 HAVING count(*) = 2), r AS (SELECT * FROM rows_ SEMI JOIN whole USING (item)), tok AS (SELECT x, item, len(ok) AS n, unnest(range(1, len(ok) + 1)) AS j, unnest(ok) AS v FROM r)"""


def token_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The 0/1 tokens of every order, the item, among returned lines and among others; an order has few lines."""
    rows = table(spark, sf, "lineitem").selectExpr("int(l_quantity > 25) AS ok", "CASE WHEN l_returnflag = 'N' THEN 2 ELSE 1 END AS x", "l_orderkey AS item_id", "l_linenumber", "l_partkey", "l_suppkey")
    listed = rows.groupBy("x", "item_id").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "ok"))).alias("t"))
    return listed.select("x", "item_id", F.col("item_id").alias("cluster"), F.transform("t", lambda t: t["ok"]).alias("ok"))


def composed_sql(draws: str) -> str:
    """Composition quantities per draw b and axis point x."""
    return f"""w AS {draws}, spot AS (SELECT b, x, n, j, sum(w) AS m, sum(w * v) AS s FROM tok JOIN w USING (item) GROUP BY 1, 2, 3, 4 HAVING sum(w) > 0),
per AS (SELECT b, x, len(ok) AS n, sum(w) AS m, sum(w * list_min(ok)) AS s FROM r JOIN w USING (item) GROUP BY 1, 2, 3 HAVING sum(w) > 0),
pool AS (SELECT b, x, j, sum(s) / sum(m) AS p FROM spot GROUP BY 1, 2, 3), marg AS (SELECT b, x, j AS n, product(p) OVER (PARTITION BY b, x ORDER BY j) AS pred FROM pool), lc AS (SELECT b, x, n, product(s / m) AS pred_l FROM spot GROUP BY 1, 2, 3),
o AS (SELECT per.b, per.x::DOUBLE AS x, sum(m) AS n, sum(s) / sum(m) AS obs, sum(m * pred) / sum(m) AS pred, sum(m * pred_l) / sum(m) AS pred_lc FROM per JOIN marg USING (b, x, n) JOIN lc USING (b, x, n) GROUP BY 1, 2),
rate AS (SELECT b, x::DOUBLE AS x, sum(s) / sum(m) AS p FROM spot GROUP BY 1, 2)"""


@query(f"""WITH {TOKENS_SQL}, {composed_sql("(SELECT item, -1 AS b, 1 AS w FROM whole)")}
SELECT x, n::BIGINT AS n, round(p, 6) AS p, round(obs, 6) AS "A_obs", round(pred, 6) AS "A_pred", round(pred_lc, 6) AS "A_pred_lc", round(obs - pred, 6) AS phi, round(obs - pred_lc, 6) AS phi_lc FROM o JOIN rate USING (b, x)""")
def composition(spark, sf):
    return rounded(C.composition_points(token_rows(spark, sf), "x", "ok"))


AXIS = {"p": "p", "A_obs": "obs", "A_pred": "pred", "A_pred_lc": "pred_lc", "phi": "obs - pred", "phi_lc": "obs - pred_lc", "chi_obs": "chi_obs", "chi_pred": "chi_pred", "chi_pred_lc": "chi_pred_lc"}


@query(f"""WITH {TOKENS_SQL}, {composed_sql(draws_of("whole", "item"))}, c AS (SELECT b, x, p AS rate, obs, pred, pred_lc FROM o JOIN rate USING (b, x)), c1 AS (SELECT b, x, rate, obs, pred, pred_lc, chi_obs FROM {gradient_sql("obs", "c")}),
c2 AS (SELECT b, x, rate, obs, pred, pred_lc, chi_obs, chi_pred FROM {gradient_sql("pred", "c1")}), c3 AS (SELECT b, x, rate AS p, obs, pred, pred_lc, chi_obs, chi_pred, chi_pred_lc FROM (SELECT * EXCLUDE (p) FROM {gradient_sql("pred_lc", "c2")})),
top AS (SELECT b, max(chi_obs) AS chi, first(x ORDER BY chi_obs DESC, x) AS best, min(x) AS a, max(x) AS z, first(chi_obs - chi_pred ORDER BY chi_obs DESC, x) AS gap, first(chi_obs - chi_pred_lc ORDER BY chi_obs DESC, x) AS gap_lc FROM c3 GROUP BY 1),
long AS ({" UNION ALL ".join(f"SELECT b, x, '{q}' AS quantity, {e} AS v FROM c3" for q, e in AXIS.items())} UNION ALL SELECT b, x::DOUBLE, 'phi_l' || n, s / m - pred_l FROM per JOIN lc USING (b, x, n)
  UNION ALL SELECT b, NULL, 'peak_chi', chi FROM top UNION ALL SELECT b, NULL, 'peak_x', best FROM top UNION ALL SELECT b, NULL, 'peak_at_edge', (best IN (a, z))::INT FROM top UNION ALL SELECT b, NULL, 'peak_chi_gap', gap FROM top UNION ALL SELECT b, NULL, 'peak_chi_gap_lc', gap_lc FROM top) {SUMMED}""")
def axis_curve_ci(spark, sf):
    return rounded(C.axis_curves(token_rows(spark, sf), "x", "ok", n_boot=CURVE_DRAWS, engine="poisson"), 5)


@query()
def subsampled_sharpness(spark, sf):
    return C.subsampled_sharpness(token_rows(spark, sf), "x", "ok", [10, 50], 50)


# == events ==


def log(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").selectExpr("ts AS t", "'unit' AS event", "event_type AS status", "CASE WHEN event_type = 'error' THEN concat('HTTP ', event_id % 3 + 500, ' after ', props, ' id deadbeef0123456') END AS error", "value AS latency_s", "user_id", "event_id")


@query("SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def event_status_counts(spark, sf):
    return E.status_counts(log(spark, sf))


@query("SELECT round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events")
def latency_quantiles(spark, sf):
    return rounded(E.latency(log(spark, sf)))


@query("SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1")
def per_minute(spark, sf):
    return E.per_minute(log(spark, sf))


@query("SELECT user_id, after, gap_s FROM (SELECT user_id, lag(ts) OVER w AS after, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS gap_s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)) WHERE gap_s > 43200")
def stalls(spark, sf):
    return E.stalls(log(spark, sf), 43200.0, by="user_id")


@query("""SELECT regexp_replace('HTTP ' || (event_id % 3 + 500) || ' after ' || props || ' id deadbeef0123456', '\\b[0-9a-f]{12,}\\b|\\d+(?:\\.\\d+)?', '#', 'g')[1:160] AS kind, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events WHERE event_type = 'error' GROUP BY 1""")
def error_kinds(spark, sf):
    return E.error_kinds(log(spark, sf)).drop("example")


@query("SELECT event_id, (count(*) FILTER (event_type = 'signup') OVER (ORDER BY ts))::BIGINT AS run FROM events")
def run_index(spark, sf):
    events = table(spark, sf, "events").select(F.col("ts").alias("t"), F.col("event_type").alias("event"), "event_id")
    return E.run_index(events, "signup").select("event_id", "run")


@query("""WITH l AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN '???' WHEN event_id % 2 = 0 THEN 'load shard=' || event_id ELSE 'score id=u' || event_id || ' v=' || round(value, 2) END AS line FROM events)
SELECT line, CASE WHEN line LIKE 'load%' THEN 'load' WHEN line LIKE 'score%' THEN 'score' END AS event, CASE WHEN line LIKE 'load%' THEN regexp_extract(line, '(\\d+)', 1) WHEN line LIKE 'score%' THEN regexp_extract(line, 'id=(\\w+)', 1) END AS what FROM l""")
def parse_log(spark, sf):
    lines = table(spark, sf, "events").selectExpr("CASE WHEN event_id % 11 = 0 THEN '???' WHEN event_id % 2 = 0 THEN concat('load shard=', event_id) ELSE concat('score id=u', event_id, ' v=', round(value, 2)) END AS value")
    parsed = jsonl.parse_log(lines, {"load": r"load shard=(?P<what>\d+)", "score": r"score id=(?P<what>\w+) v=(?P<v>[-\d.]+)"})
    return parsed.select("line", "event", F.col("fields")["what"].alias("what"))


@query("SELECT date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1")
def stream_per_minute(spark, sf):
    stream = live.file_stream(spark, f"{sf}/events.parquet").select(F.col("ts").cast("timestamp").alias("t"))
    out = live.drain(live.per_minute(stream), f"per_minute_{uuid.uuid4().hex[:8]}")
    return out.select(F.col("minute").cast("timestamp_ntz").alias("minute"), "n")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def stream_latest(spark, sf):
    stream = live.file_stream(spark, f"{sf}/events.parquet").select("user_id", "event_id", "event_type")
    return live.drain(live.latest(stream, "user_id", "event_id"), f"latest_{uuid.uuid4().hex[:8]}")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def stream_counts(spark, sf):
    stream = live.file_stream(spark, f"{sf}/events.parquet")
    return live.drain(live.counts(stream, "event_type"), f"counts_{uuid.uuid4().hex[:8]}")


@query("""SELECT page_id, regexp_extract(url, '^(https?)://', 1) AS scheme, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<a href=')) AS links FROM pages""")
def pages_parse(spark, sf):
    e = lambda c, p: F.regexp_extract(c, p, 1)
    return table(spark, sf, "pages").select("page_id", e("url", "^(https?)://").alias("scheme"), e("url", "^https?://([^/?#]+)").alias("host"), e("html", "<title>([^<]*)</title>").alias("title"), F.regexp_count("html", F.lit("<a href=")).alias("links"))


from plumbline import catalog_runs as catalog_runs  # noqa: E402  registers its queries as well
