import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm import packing as K

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id bigint, text string, Length string, part int"


@pytest.fixture(scope="module")
def tokens():
    return K.Tokens(PATH)


@given(st.lists(st.sampled_from(["a", "The", " ", "  ", "\n", "\t", "é", "'s", "12", "!?", " ", " ", "\x1c", "\x85", "日本", "<|endoftext|>", "\r\n"]), max_size=12).map("".join))
@settings(max_examples=400, deadline=None)
def test_ids_are_the_librarys(tokens, text):
    assert tokens.full is not None
    assert tokens.ids(text) == tokens.tokenizer.encode(text, add_special_tokens=False).ids


def test_pieces_cover_every_id(spark):
    rng = random.Random(5)
    words = ["alpha", "Beta,", "gamma\n", "12.5", "Ünder"]
    rows = [(None, "x y"), (1, None), (2, ""), (3, " ".join(rng.choices(words, k=30_000))), (4, "same"), (4, "same")]
    rows += [(10 + i, " ".join(rng.choices(words, k=rng.randrange(1, 900)))) for i in range(300)]
    got = K.pack(spark.createDataFrame([(d, t, "z", 9) for d, t in rows], SCHEMA).repartition(5), PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for d, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(d, s, len(ids[s : s + 1024]), zlib.crc32(ids[s : s + 1024].tobytes()), len(ids)) for s in range(0, len(ids), 1024)]
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got), key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    assert sorted(by) == list(range(len(by)))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(r.length for r in got)
    assert len(by) * 1024 <= 1.02 * total


def test_nothing(spark):
    assert K.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def best_fit(widths, demand, room):
    bins = []
    for w, n in sorted(zip(widths.tolist(), demand.tolist()), reverse=True):
        for _ in range(n):
            fit = [i for i, b in enumerate(bins) if b >= w]
            if fit:
                i = min(fit, key=lambda i: bins[i])
                bins[i] -= w
            else:
                bins.append(room - w)
    return len(bins)


@pytest.mark.parametrize("seed", range(6))
def test_plan_covers_the_demand(seed):
    rng = np.random.default_rng(seed)
    room = 64
    widths = np.sort(rng.choice(np.arange(1, room), rng.integers(1, 40), replace=False))
    demand = rng.integers(1, [3, 50, 1000][seed % 3], len(widths))
    plan = K.plan_sequences(widths, demand, room)
    made = np.zeros(len(widths), int)
    for bag, times in plan:
        assert sum(widths[j] * n for j, n in bag.items()) <= room
        for j, n in bag.items():
            made[j] += n * times
    assert (made == demand).all()
    used = sum(t for _, t in plan)
    assert -(-int(widths @ demand) // room) <= used <= best_fit(widths, demand, room) * 1.02 + 1


def test_linear_program_reaches_its_bound():
    widths, demand = np.array([20, 45, 50, 55, 75]), np.array([48.0, 35, 24, 10, 8])
    found = K.solve_patterns(widths, demand, 110, gap=0)
    assert all(use >= 0 and pattern @ widths <= 110 for pattern, use in found)
    assert np.allclose(sum(pattern * use for pattern, use in found), demand)
    every = [p for p in np.ndindex(6, 3, 3, 3, 2) if np.array(p) @ widths <= 110]
    value = sum(use for _, use in found)
    rng = np.random.default_rng(0)
    for _ in range(2000):  # no feasible dual is above the value
        dual = rng.random(5)
        dual /= max(np.array(every) @ dual)
        assert dual @ demand <= value + 1e-6


def test_knapsack_by_enumeration():
    widths, value = np.array([3, 4, 7]), np.array([0.3, 0.45, 0.8])
    best, pattern = K._knapsack(value, widths, 17)
    every = [(a * 0.3 + b * 0.45 + c * 0.8) for a in range(6) for b in range(5) for c in range(3) if 3 * a + 4 * b + 7 * c <= 17]
    assert abs(best - max(every)) < 1e-12 and abs(pattern @ value - best) < 1e-12
