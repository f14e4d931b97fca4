"""String functions as column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize(s: Column, case: bool = False, punct: bool = False) -> Column:
    """Lower case unless ``case``, without ASCII punctuation unless ``punct``, white space collapsed."""
    s = s if case else F.lower(s)
    s = s if punct else F.translate(s, string.punctuation, "")
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


#: Characters whose capital is one character in SQL and two in Java; ligatures and the like have no capital of one.
_OWN_CAPITAL = {"ß": "ẞ", "ᾳ": "ᾼ", "ῃ": "ῌ", "ῳ": "ῼ"} | {chr(c): chr(c + 8) for a in (0x1F80, 0x1F90, 0x1FA0) for c in range(a, a + 8)}


def upper(s: Column) -> Column:
    """Capitals as SQL has them, one for one: the length stays, ``ß`` is ``ẞ`` and not ``SS``."""
    one = lambda c: F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, "".join(_OWN_CAPITAL), "".join(_OWN_CAPITAL.values())))
    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0)), one), "")


def error_kind(message: Column) -> Column:
    """A message with its numbers and long hexadecimal ids masked, cut to 160."""
    return F.left(F.regexp_replace(message, r"\b[a-f0-9]{12,}\b|[0-9]+(?:[.][0-9]+)?", "#"), F.lit(160))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def relative_position(text: Column, part: Column) -> Column:
    """Where ``part`` begins, from 0 at the start to 1 at the last character; negative if it is absent."""
    return (F.instr(text, part) - 1) / F.greatest(F.lit(1), F.length(text) - 1)


def coerce_number(s: Column) -> Column:
    """A VARIANT: an integer, else a float, else the string."""
    number = F.coalesce(s.try_cast("bigint").cast("variant"), s.try_cast("double").cast("variant"))
    return F.coalesce(number, s.cast("variant"))


def json_path(document: Column, path: str, kind: str = "string") -> Column:
    """A dotted path such as ``answers.0`` or ``answers.-1`` of a JSON text, NULL where it leads nowhere."""
    parts = path.split(".")
    value = document
    for p in parts:
        if p.lstrip("-").isdigit():
            items = F.from_json(value, "array<string>")
            i = int(p)
            value = F.try_element_at(items, F.lit(i if i < 0 else i + 1))
        else:
            value = F.get_json_object(value, f"$['{p}']")
    return value.try_cast(kind) if kind != "string" else value


def prompt(*parts: Column) -> Column:
    """Parts joined by blank lines, absent ones left out."""
    return F.concat_ws("\n\n", *parts)
