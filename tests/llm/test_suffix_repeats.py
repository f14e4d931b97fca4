import random
from collections import defaultdict

import numpy as np
import pytest

from plumbline.llm import suffix_repeats as R

SCHEMA = "doc_id bigint, text string, node string"


def brute_force(rows, least=50):
    """Words in windows of ``least`` words that occur at two places, or in equal texts."""
    at, copies = defaultdict(set), defaultdict(int)
    for _, t in rows:
        copies[t or ""] += 1
    for t in copies:
        w = t.split()
        for i in range(len(w) - least + 1):
            at[tuple(w[i : i + least])].add((t, i))
    spans = defaultdict(list)
    for places in at.values():
        for t, i in places if len(places) > 1 else ():
            spans[t].append((i, i + least))
    for t, n in copies.items():
        if n > 1 and len(t.split()) >= least:
            spans[t] = [(0, len(t.split()))]
    return sorted(((d, len((t or "").split()), ",".join(f"{s}:{e}" for s, e in R.merge_spans(spans[t or ""]))) for d, t in rows if spans.get(t or "")), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [rng.choices(vocabulary, k=k) for k in (49, 50, 51, 60, 75, 120, 400)]
    rows = [(1, None), (2, ""), (None, " ".join(passages[4])), (3, "short text"), (3, "short text")]
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.choice([10, 60, 200, 700]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            p = rng.choice(passages)
            cut = rng.choice([0, 0, 3])
            k = rng.randrange(len(words))
            words[k:k] = p[cut:]
        rows.append((10 + i, " ".join(words)))
    again = rng.choices(vocabulary, k=55)
    rows += [(900, " ".join(again + ["x"] + again)), (901, rows[-1][1]), (901, rows[-1][1]), (902, "same " * 300), (903, " ".join(rng.choices(vocabulary, k=20_000)))]
    return rows


@pytest.mark.parametrize(("seed", "hot"), [(1, 100_000), (2, 100_000), (1, 5), (2, 1)])
def test_passages(spark, seed, hot):
    rows = corpus(seed)
    got = R.repeated_passages(spark.createDataFrame([(d, t, "z") for d, t in rows], SCHEMA), R.Repeats(hot=hot)).collect()
    assert sorted(((r.doc_id, r.n_words, r.spans) for r in got), key=repr) == brute_force(rows)
    assert all(r.n_repeated == sum(int(b) - int(a) for a, b in (s.split(":") for s in r.spans.split(","))) for r in got)


def test_nothing(spark):
    assert R.repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_every_passage_selects_a_position():
    rng = np.random.default_rng(1)
    repeats = R.Repeats()
    passage = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    for _ in range(50):
        a, b = (np.concatenate([rng.integers(0, 1 << 63, rng.integers(0, 90), dtype=np.uint64), passage, rng.integers(0, 1 << 63, rng.integers(0, 90), dtype=np.uint64)]) for _ in range(2))
        starts = [next(i for i in range(len(v)) if (v[i : i + 50] == passage[: len(v[i : i + 50])]).all() and len(v[i : i + 50]) == 50) for v in (a, b)]
        inside = [{p - s for p in R.selected(v, repeats).tolist() if s <= p <= s + 25} for v, s in zip((a, b), starts)]
        assert inside[0] & inside[1]


def test_one_prefix_in_many_documents():
    repeats = R.Repeats(pairs=4, block=50)
    rows = [(i, 30, bytes([i % 7]) * 100, b"\x01" * 100) for i in range(300)]
    assert len({n for n, _, _ in R.compare_block(rows, repeats)}) == 300


def boilerplate(texts=4500, seed=4):
    """45 words in all texts; every third text has the 10 words before them in common with one other."""
    rng = random.Random(seed)
    own = lambda k: [f"u{rng.getrandbits(60)}" for _ in range(k)]
    common, heads = own(45), [own(10) for _ in range(texts // 6)]
    heads += heads + [own(10) for _ in range(texts - 2 * len(heads))]
    rng.shuffle(heads)
    return [(i, " ".join(own(i % 7) + h + common + own(rng.choice([0, 3, 30])))) for i, h in enumerate(heads)]


def test_many_suffixes_that_share_fewer_words(spark):
    rows = boilerplate()
    got = R.repeated_passages(spark.createDataFrame([(d, t, "z") for d, t in rows], SCHEMA)).collect()
    want = brute_force(rows)
    assert len(want) == 1500
    assert len(got) == 1500
    assert sorted(((r.doc_id, r.n_words, r.spans) for r in got), key=repr) == want


@pytest.mark.parametrize("seed", [1, 2])
def test_counted_windows_are_the_compared_ones(seed):
    rng = random.Random(seed)
    side = lambda: b"".join(bytes([rng.random() < 0.06, 0, 0, 1]) for _ in range(rng.choice([3, 25, 25, 25])))
    rows = [(i, 30, side(), side()) for i in range(200)]
    spans = [set(R.compare_block(rows, R.Repeats(pairs=p, block=b))) for p, b in ((1000, 9), (4, 9), (4, 2048))]
    assert 0 < len(spans[0]) <= 200 and spans[0] == spans[1] == spans[2]
