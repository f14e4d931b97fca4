"""Quality rules: repetition coverage from rolling hashes of several n-gram lengths.

A document is split into words at ASCII white space. Every word becomes a 64-bit value and a
window of n words the sum of its values times powers of an odd multiplier, so that the hashes of
n + 1 words follow from those of n. Only windows that are duplicated at n are looked at for
n + 1, which leaves little to sort after the first length. The work is per document: nothing is
shuffled, and memory is bounded by a slice of the Arrow batch.

Defined results: a null or blank text has no words, fails the base rules and is not kept; a text
of one endless word counts as one word; repeated rows and null ids give a row each; columns
beyond ``doc_id`` and ``text`` are ignored by :func:`repetition_report` and kept by
:func:`keep_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import any_names, mix64, only, raw_texts, sliced

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
BASE_WINDOW = 8


@dataclass(frozen=True)
class Limits:
    """Largest share of word characters, in percent, that may lie in repeated material.

    ``ngrams`` counts characters in windows that occurred earlier in the text, by window length;
    ``line_chars`` counts characters in lines that occurred earlier.
    """

    ngrams: tuple[tuple[int, int], ...] = ((5, 30), (6, 28), (7, 26), (8, 24), (9, 22), (10, 20))
    line_chars: int = 30
    min_words: int = 20
    repeat_words: int = 30


class _Words(dict):
    """Numbers words in order of appearance and keeps their lengths in code points."""

    def __init__(self) -> None:
        super().__init__()
        self.chars: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.chars)
        self.chars.append(len(word.decode("utf-8", "replace")))
        return n


def _marks(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    """Which of n positions lie in a window of ``width`` that begins at one of ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether it occurs elsewhere, and whether it occurs earlier."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def measure(texts: list[bytes | None], limits: Limits, words: _Words) -> dict[str, np.ndarray]:
    """The counts of a slice of documents, as arrays with one entry per document."""
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars")}
    ids: list[int] = []
    for i, text in enumerate(texts):
        if not text:
            continue
        own = text.split()
        out["n_words"][i] = len(own)
        ids.extend(map(words.__getitem__, own))
        out["n_symbols"][i] = len(text) - len(text.translate(None, SYMBOLS))
        if b"\n" in text:
            seen: set[bytes] = set()
            for line in text.split(b"\n"):
                if line in seen:
                    out["n_dup_lines"][i] += 1
                    out["dup_line_chars"][i] += sum(map(words.chars.__getitem__, map(words.__getitem__, line.split())))
                elif line and not line.isspace():
                    seen.add(line)
    token = np.array(ids, dtype=np.int64)
    chars = np.asarray(words.chars, dtype=np.int64)[token] if ids else np.zeros(0, np.int64)
    ends = np.cumsum(out["n_words"])
    doc = np.repeat(np.arange(n), out["n_words"])
    total = lambda weights: np.bincount(doc, weights=weights, minlength=n).astype(np.int64)
    out["word_chars"] = total(chars)
    widths = sorted({w for w, _ in limits.ngrams} | {BASE_WINDOW})
    value = mix64(token)
    step = np.uint64(0x2545F4914F6CDD1D)
    factor, rolled, width = np.uint64(1), mix64(doc.astype(np.uint64) + np.uint64(1 << 40)), 0
    room = ends[doc] - np.arange(len(token)) if n else token
    alive = np.arange(len(token))
    covered = {w: np.zeros(n, np.int64) for w in widths}
    with np.errstate(over="ignore"):
        for w in widths:
            alive = alive[room[alive] >= w]
            for k in range(width, w):
                at = alive if len(alive) < len(token) else slice(None)
                rolled[at] += value[alive + k] * factor
                factor *= step
            width = w
            if not len(alive):
                break
            twice, later = _repeats(rolled[alive])
            covered[w] = total(chars * _marks(len(token), alive[later], w))
            alive = alive[twice]
            if w == BASE_WINDOW:
                out["n_repeat_words"] = total(_marks(len(token), alive, w))
    for w in widths:
        out[f"dup_{w}gram_chars"] = covered[w]
    return out


def verdict(counts: dict[str, np.ndarray], limits: Limits) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept); every comparison is between integers."""
    failed = (counts["n_words"] < limits.min_words) | (100 * counts["n_repeat_words"] > limits.repeat_words * counts["n_words"])
    bad = 100 * counts["dup_line_chars"] > limits.line_chars * counts["word_chars"]
    for w, most in limits.ngrams:
        bad |= 100 * counts[f"dup_{w}gram_chars"] > most * counts["word_chars"]
    return failed, ~failed & ~bad


def _report(limits: Limits, extra: list[str], slice_bytes: int, most_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in sliced(batches, "text", slice_bytes):
            if len(words) > most_words:
                words = _Words()
            counts = measure(raw_texts(batch.column("text")), limits, words)
            failed, kept = verdict(counts, limits)
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *extra]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(counts[k]) for k in names], pa.array(failed), pa.array(kept)],
                names=["doc_id", *names, "base_failed", "kept"],
            )

    return run


def repetition_report(docs: DataFrame, limits: Limits | None = None, slice_bytes: int = 4 << 20, most_words: int = 500_000) -> DataFrame:
    """One row per row of ``docs``: word, symbol and repetition counts with the verdict.

    ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` are the base
    counts; ``dup_line_chars`` and ``dup_<n>gram_chars`` are the characters inside repeated lines and
    windows; ``base_failed`` and ``kept`` the verdicts.
    """
    limits = limits or Limits()
    extra = ["dup_line_chars", *[f"dup_{w}gram_chars" for w in sorted({w for w, _ in limits.ngrams} | {BASE_WINDOW})]]
    kind = only(docs, "doc_id").schema[0].dataType.simpleString()
    longs = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *extra]
    schema = f"doc_id {kind}, {', '.join(f'{c} bigint' for c in longs)}, base_failed boolean, kept boolean"
    return only(docs, "doc_id", "text").mapInArrow(_report(limits, extra, slice_bytes, most_words), schema)


@any_names
def keep_documents(docs: DataFrame, limits: Limits | None = None, slice_bytes: int = 4 << 20, most_words: int = 500_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose text passes the rules; no shuffle."""
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        for batch in sliced(batches, "text", slice_bytes):
            if len(words) > most_words:
                words = _Words()
            kept = verdict(measure(raw_texts(batch.column("text")), limits, words), limits)[1]
            yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
