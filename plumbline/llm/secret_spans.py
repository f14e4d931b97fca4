"""Secret scans with multipart credential linking, with DataFrame functions only.

Base kinds are found by patterns alone: ``assign`` (a secret word given a value), ``access`` (an
access identifier) and ``hex`` (a long hexadecimal run). Weak parts are identifiers (``id``), free
standing keys (``key``) and endpoints (``endpoint``); each is common in clean text, so it is reported
only if complementary parts lie in the same scope, a block of text without a blank line: an identifier
needs a secret, a key an identifier or an endpoint, and an endpoint both an identifier and a secret. A
weak part that overlaps a base span is that span and no part of its own.

Parts are found within the row and written. The interval join is a sweep: the intervals of a text
that has weak parts are sorted by start in both directions, and running values give each part its
scope and the base spans that reach into it; what a scope holds then decides. So a text costs
n log n in its parts, and only intervals, never texts, are shuffled.

Positions are code points, ends exclusive. They follow from the lengths of matches and of the text
between them, summed in two levels so that texts with very many matches stay affordable.

Defined results: a null text is empty and has no spans; null ids and repeated rows are rows of
their own; extra columns are ignored by :func:`secret_report` and kept by :func:`mask_secrets`.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import any_names, let, only, written

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
IDENTIFIER = r"""(?i)(?<![A-Za-z0-9])(?:user_?(?:name|id)?|login|client_?id|access_?key_?id|account_?(?:name|id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9@._-]{2,}"""
KEY = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{32,}+={0,2}(?![A-Za-z0-9+/_=-])"
ENDPOINT = r"""(?i)(?:(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb(?:\+srv)?|rediss?|amqps?|ftps?|ssh|s3)://[^\s"'<>]+|(?<![A-Za-z0-9])(?:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9][A-Za-z0-9.:_-]{3,})"""
BLANK = r"\n[\x20\t\r]*\n"
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
SPAN = "array<struct<start:int,rank:int,end:int>>"
BASE, BREAK = 3, len(KINDS)
MASK = "[SECRET]"
BLOCK = 128


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _spans(text: Column, pattern: str, rank: int, keep=None, gate: Column | None = None) -> Column:
    """Spans of all non-overlapping matches, leftmost first.

    ``keep`` filters matches by their text; where ``gate``, a cheap test, is false there are none.
    """

    def place(pieces: Column, matches: Column) -> Column:
        def sums(gaps: Column, steps: Column) -> Column:
            blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda b: _total(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))))

            def at(blocks: Column) -> Column:
                def span(m: Column, i: Column) -> Column:
                    block = F.floor(i / BLOCK).cast("int")
                    start = _total(F.slice(blocks, F.lit(1), block)) + _total(F.slice(steps, block * BLOCK + 1, i - block * BLOCK)) + gaps[i]
                    return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(m)).alias("end"), m.alias("m"))

                return F.transform(matches, span)

            return let(blocks, at)

        gaps = F.transform(pieces, lambda p: F.length(p))
        return let(gaps, lambda g: let(F.zip_with(F.slice(g, F.lit(1), F.size(matches)), matches, lambda a, m: a + F.length(m)), lambda s: sums(g, s)))

    found = let(F.split(text, pattern, -1), lambda p: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: place(p, m)))
    if keep is not None:
        found = F.filter(found, lambda s: keep(s["m"]))
    bare = F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    there = text.rlike(pattern) if gate is None else gate & text.rlike(pattern)
    return F.when(there, bare).otherwise(F.array().cast(SPAN))


def _set(text: Column) -> Column:
    """Without a colon or an equals sign nothing is given a value and no endpoint is named."""
    return text.contains(":") | text.contains("=")


def credential_parts(text: Column) -> Column:
    """A struct of the spans of every kind and, where there are weak ones, of blank lines (``breaks``)."""

    def all_of(t: Column) -> Column:
        base = F.struct(
            _spans(t, ASSIGN, 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6, _set(t)).alias("assign"),
            _spans(t, ACCESS, 1, gate=t.contains("AKIA")).alias("access"), _spans(t, HEX, 2).alias("hex"),
            _spans(t, IDENTIFIER, 3, gate=_set(t)).alias("id"), _spans(t, ENDPOINT, 5, gate=_set(t)).alias("endpoint"),
        )

        def with_keys(b: Column) -> Column:
            partners = F.size(b["id"]) + F.size(b["endpoint"]) + F.size(b["access"]) > 0  # without them no key is reported

            def parted(key: Column) -> Column:
                own = [key.alias(k) if k == "key" else b[k].alias(k) for k in KINDS]
                some = F.size(b["id"]) + F.size(key) + F.size(b["endpoint"]) > 0
                return F.struct(*own, F.when(some, _spans(t, BLANK, BREAK)).otherwise(F.array().cast(SPAN)).alias("breaks"))

            return let(_spans(t, KEY, 4, gate=partners), parted)

        return let(base, with_keys)

    return let(F.coalesce(text, F.lit("")), all_of)


def _numbered(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns of ``docs`` with a row number and the parts of its texts, written once."""
    own = docs.select(*[F.col(f"`{c}`") for c in keep], credential_parts(F.col("text")).alias("__parts"))
    return written(own.withColumn("__row", F.monotonically_increasing_id()), "secret-parts")


def _has_weak() -> Column:
    return F.size("__parts.id") + F.size("__parts.key") + F.size("__parts.endpoint") > 0


def linked_spans(numbered: DataFrame) -> DataFrame:
    """``__row`` and the weak spans whose scope holds what complements them."""
    intervals = numbered.where(_has_weak()).select("__row", F.inline(F.concat(*[F.col(f"__parts.{k}") for k in (*KINDS, "breaks")])))
    text = Window.partitionBy("__row")
    ahead = text.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    back = text.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rank, base = F.col("rank"), F.col("rank") < BASE
    swept = intervals.select(
        "*", F.count_if(rank == BREAK).over(ahead).alias("scope"),
        F.max(F.when(base, F.col("end"))).over(ahead).alias("reached"), F.min(F.when(base, F.col("start"))).over(back).alias("next"),
    )
    apart = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    scope = Window.partitionBy("__row", "scope")
    holds = lambda *ranks: F.bool_or(rank.isin(*ranks)).over(scope)
    judged = swept.where((rank < BREAK) & (base | apart)).select("*", holds(1, 3).alias("ids"), holds(0, 2, 4).alias("secrets"), holds(5).alias("endpoints"))
    linked = judged.where("rank = 3 AND secrets OR rank = 4 AND (ids OR endpoints) OR rank = 5 AND ids AND secrets")
    return linked.groupBy("__row").agg(F.collect_list(F.struct("start", "rank", "end")).alias("__linked"))


def _named(spans: Column) -> Column:
    name = lambda s: F.concat(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1), F.lit(":"), s["start"], F.lit(":"), s["end"])
    return F.array_join(F.transform(F.array_sort(spans), name), ",")


def secret_report(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: counts of base kinds, the digest of base spans and all spans."""
    numbered = _numbered(only(docs, "doc_id", "text"), ["doc_id"])
    found = numbered.join(linked_spans(numbered), "__row", "left")
    base = F.concat("__parts.assign", "__parts.access", "__parts.hex")
    every = F.concat(base, F.coalesce("__linked", F.array().cast(SPAN)))
    count = lambda k: F.size(f"__parts.{k}").cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_named(base), 256).alias("base_sha256"), _named(every).alias("spans"))


@any_names
def mask_secrets(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """``docs`` with every reported span of ``text`` replaced; ``n_chars``, where there, follows.

    Only rows with weak parts meet the linked spans in a shuffle.
    """
    numbered = _numbered(docs, docs.columns)
    alone = numbered.where(~_has_weak()).withColumn("__linked", F.array().cast(SPAN))
    weak = numbered.where(_has_weak()).join(linked_spans(numbered), "__row", "left")
    text = F.col("text")

    def masked(spans: Column, ends: Column) -> Column:
        reached = lambda n: F.coalesce(F.array_max(F.slice(ends, F.lit(1), n)), F.lit(0))

        def cut(s: Column, i: Column) -> Column:
            piece = lambda b: F.when(s["start"] >= b, F.concat(F.substring(text, b + 1, s["start"] - b), F.lit(mask))).otherwise("")
            return let(reached(i), piece)

        return F.concat(F.array_join(F.transform(spans, cut), ""), let(reached(F.size(ends)), lambda b: F.substring(text, b + 1, F.length(text))))

    every = F.array_sort(F.concat("__parts.assign", "__parts.access", "__parts.hex", F.coalesce("__linked", F.array().cast(SPAN))))
    new = let(every, lambda s: F.when(F.size(s) > 0, let(F.transform(s, lambda x: x["end"]), lambda e: masked(s, e))).otherwise(text))
    out = alone.unionByName(weak).select(*[new.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
