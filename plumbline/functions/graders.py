"""Graders as column expressions.

A grader takes the text and the gold (a string or an array of aliases) and gives a struct whose
``correct`` is a DOUBLE, or NULL where the text cannot be parsed: such a row is ``unparsed``. Blank
texts never parse. Options are checked when the expression is built.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import normalize

GRADERS: dict[str, Callable[..., Column]] = {}
CUES = (
    *(f"{verb} {rest}" for rest, verbs in {"answer": ("cannot", "can't"), "find": ("cannot", "can't", "could not", "couldn't", "unable to"), "contain": ("do not", "does not", "doesn't", "don't")}.items() for verb in verbs),
    *(f"no {what}" for what in ("evidence", "information", "mention")),
    *(f"not {what}" for what in ("finding", "in the", "mentioned", "present")),
    "does not appear", "unknown", "cannot be determined",
)
NUMBER = "(-?(?:" + "[0-9]{1,3}" + "(?:,[0-9]{3})+" + r"(?![0-9])|\d+)(?:[.]\d+)?" + r"|-?[.]\d+)"


def grader(name: str, replace: bool = False):
    """Register an expression builder under a name of its own."""

    def add(build: Callable[..., Column]) -> Callable[..., Column]:
        if name in GRADERS and not replace:
            raise ValueError(f"there is a grader {name!r}; pass replace=True to take its place")
        GRADERS[name] = build
        return build

    return add


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False)).cast("double")


def _parsed(text: Column, result: Column, test: Column | None = None) -> Column:
    ok = F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")), F.lit("")) != ""
    return F.when(ok if test is None else ok & test, result)


def _aliases(gold: Column, many: bool, case: bool, punct: bool) -> Column:
    golds = gold if many else F.array(gold.cast("string"))
    golds = F.transform(golds, lambda g: normalize(g, case, punct))
    return F.when(F.exists(golds, lambda g: g == "") | (F.size(golds) == 0), F.raise_error(F.lit("a gold answer normalises to nothing"))).otherwise(golds)


@grader("exact")
def exact(text: Column, gold: Column, many: bool = False, case: bool = False, punct: bool = False, extract: str | None = None) -> Column:
    """Equal to an alias after normalising; ``extract`` names the answer by its first group."""
    raw = text if extract is None else F.regexp_extract(text, f"(?s){extract}", 1)
    pred = normalize(raw, case, punct)
    found = None if extract is None else text.rlike(f"(?s){extract}")
    return _parsed(text, F.struct(_flag(F.array_contains(_aliases(gold, many, case, punct), pred)).alias("correct"), pred.alias("pred")), found)


@grader("contains")
def contains(text: Column, gold: Column, many: bool = False, case: bool = False, punct: bool = False) -> Column:
    """An alias occurs in the text, both normalised."""
    t = normalize(text, case, punct)
    return _parsed(text, F.struct(_flag(F.exists(_aliases(gold, many, case, punct), lambda g: F.contains(t, g))).alias("correct")))


@grader("numeric")
def numeric(text: Column, gold: Column, tol: float = 0.0, rel: float = 0.0, pick: str = "last") -> Column:
    """The first or last number of the text within max(tol, rel * |gold|)."""
    if pick != "first" and pick != "last":
        raise ValueError(f"{pick!r} is no way to pick: say first or last")
    found = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))
    x = F.replace(F.try_element_at(found, F.lit(-1 if pick == "last" else 1)), F.lit(","), F.lit("")).try_cast("double")
    g = gold.cast("double")
    gap = F.abs(x - g)
    return _parsed(text, F.struct(_flag(gap <= F.greatest(F.lit(float(tol)), rel * F.abs(g))).alias("correct"), x.alias("pred"), gap.alias("abs_err")), F.size(found) > 0)


@grader("choice")
def choice(text: Column, gold: Column, options: str = "ABCD") -> Column:
    """The letter of the last explicit answer, else the only option letter that stands alone."""
    up, low, any_ = re.escape(options.upper()), re.escape(options.lower()), re.escape(options)
    said = rf"(?i:answer)(?:\s*(?:is|:))?\s*(?:[(]?[{up}][)]?\b|[(][{low}][)]|[{low}](?=\s*(?:[!,.:;?]|$)))"
    last = F.try_element_at(F.regexp_extract_all(text, F.lit(f"({said})"), F.lit(1)), F.lit(-1))
    stated = F.upper(F.regexp_extract(last, rf"([{up}{low}])\)?\s*$", 1))
    alone = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<![a-zA-Z])[(]?([{any_}])[)]?(?![a-zA-Z])"), F.lit(1)))
    pred = F.when(last.isNotNull(), stated).when(F.size(alone) == 1, alone[0])
    known = F.when(F.upper(gold).isin(*options.upper()), gold).otherwise(F.raise_error(F.lit(f"a gold letter is none of {options}")))
    return _parsed(text, F.struct(_flag(pred == F.upper(known)).alias("correct"), pred.alias("pred")), pred.isNotNull())


@grader("yes_no")
def yes_no(text: Column, gold: Column) -> Column:
    """Exactly one of the words yes and no occurs."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"\b(yes|no)\b"), F.lit(1)))
    pred = F.when(F.size(words) == 1, words[0])
    return _parsed(text, F.struct(_flag(pred == F.lower(gold)).alias("correct"), pred.alias("pred")), pred.isNotNull())


@grader("set_f1")
def set_f1(text: Column, gold: Column, pattern: str) -> Column:
    """Distinct matches of a pattern against the gold set: equality, precision, recall and F1."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1 if re.compile(pattern).groups else 0)))
    truth = F.array_distinct(gold)
    tp = F.size(F.array_intersect(found, truth)).cast("double")
    p = tp / F.size(found)
    r = F.when(F.size(truth) > 0, tp / F.nullif(F.size(truth), F.lit(0))).otherwise(0.0)
    f1 = F.when(tp > 0, 2 * p * r / F.nullif(p + r, F.lit(0.0))).otherwise(0.0)
    equal = (tp == F.size(found)) & (tp == F.size(truth))
    return _parsed(text, F.struct(_flag(equal).alias("correct"), p.alias("precision"), r.alias("recall"), f1.alias("f1"), F.size(found).alias("n_pred")), F.size(found) > 0)


def declines(text: Column, cues: Sequence[str] = CUES) -> Column:
    t = normalize(text, punct=True)
    return F.exists(F.array(*[F.lit(c) for c in cues]), lambda c: F.contains(t, c))


@grader("abstain")
def abstain(text: Column, gold: Column | None = None, cues: Sequence[str] = CUES) -> Column:
    """Correct where the text declines; an answer is a hallucination, counted apart."""
    said = declines(text, cues)
    return _parsed(text, F.struct(_flag(said).alias("correct"), _flag(said).alias("abstained"), _flag(~said).alias("hallucinated")))


@grader("label")
def label(text: Column, gold: Column, options: Sequence[str]) -> Column:
    """Exactly one of the options is named as a whole word, in any case."""
    t = F.lower(text)
    named = [F.when(t.rlike(r"(?<!\w)" + re.escape(o.lower()) + r"(?!\w)"), F.lit(o)) for o in options]
    found = F.array_compact(F.array(*named))
    pred = F.when(F.size(found) == 1, found[0])
    known = F.when(gold.isin(*options), gold).otherwise(F.raise_error(F.lit("a gold label is none of the options")))
    return _parsed(text, F.struct(_flag(pred == known).alias("correct"), pred.alias("pred")), pred.isNotNull())


def grade(spec: str | dict, text: Column, gold: Column) -> Column:
    """By a grader's name or ``{"name": ..., options}``; ``"abstain": true`` parts declined from wrong."""
    options = {"name": spec} if isinstance(spec, str) else dict(spec)
    name = options.pop("name")
    if name not in GRADERS:
        raise KeyError(f"no grader {name!r}; there are {sorted(GRADERS)}")
    split = options.pop("abstain", False)
    if not isinstance(split, bool) or (split and name == "abstain"):
        raise ValueError("abstain is true or false, and not for the abstain grader")
    try:
        out = GRADERS[name](text, gold, **options)
    except TypeError as e:
        raise ValueError(f"grader {name!r}: {e}") from e
    if not split:
        return out
    said = F.coalesce(declines(text), F.lit(False))
    correct = F.when(said, 0.0).otherwise(out["correct"])
    return _parsed(text, F.struct(correct.alias("correct"), F.when(said, 0.0).otherwise(1 - out["correct"]).alias("wrong"), said.cast("double").alias("abstained")), said | out.isNotNull())


def score_rows(rows: DataFrame, specs: dict[str, str | dict], default: str | None = None) -> DataFrame:
    """Grade each row by the spec its ``grader`` column names: adds ``correct`` and ``status``.

    Rows whose status is not ok keep it; a text that does not parse makes it ``unparsed``.
    """
    name = F.coalesce(F.col("grader"), F.lit(default))
    correct = F.lit(None).cast("double")
    for key, spec in specs.items():
        correct = F.when(name == key, grade(spec, F.col("text"), F.col("gold"))["correct"]).otherwise(correct)
    known = F.when(name.isin(*specs), correct).otherwise(F.raise_error(F.lit("a row names no known grader")))
    ok = F.coalesce("status", F.lit("ok")) == "ok"
    graded = rows.withColumn("correct", F.when(ok, known))
    return graded.withColumn("status", F.when(ok & F.col("correct").isNull(), "unparsed").otherwise(F.coalesce("status", F.lit("ok"))))


def score_teacher_forced(argmax_ok: Column, logp: Column) -> Column:
    """em_tf, tok_acc, sum_logp and n_target from per-token arrays."""
    hits = F.aggregate(argmax_ok, F.lit(0), lambda a, x: a + x.cast("int"))
    return F.struct(F.forall(argmax_ok, lambda x: x).cast("double").alias("em_tf"), (hits / F.size(argmax_ok)).alias("tok_acc"), F.aggregate(logp, F.lit(0.0), lambda a, x: a + x).alias("sum_logp"), F.size(argmax_ok).alias("n_target"))
