import random
import zlib

import numpy as np
import pytest

from plumbline.llm import quality as Q


def corpus(n=800, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma", "tau", "mu"]
    docs, labels = [], []
    for i in range(n):
        own = rng.choices(words, k=rng.randrange(20, 120))
        good = rng.random() < 0.7
        docs.append((i, " ".join(own).capitalize() + "." if good else " ".join(w.upper() + "$$" for w in own)))
        if rng.random() < 0.6:
            labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_documents_are_told_apart(spark):
    docs, labels = corpus()
    truth = {d: q for d, q, _ in labels}
    got = Q.quality_scores(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 50 and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97


def test_labels_of_held_out_documents_do_not_matter(spark):
    docs, labels = corpus(300)
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, t) for d, q, t in labels]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    a, b = (Q.quality_scores(frame, spark.createDataFrame(x, "doc_id bigint, quality int, toxic int").coalesce(1)) for x in (labels, flipped))
    a, b = ({r.doc_id: r.score for r in x.collect()} for x in (a, b))
    assert all(abs(a[k] - b[k]) < 1e-6 for k in a)


def test_odd_rows(spark):
    docs, labels = corpus(200)
    odd = [(None, "a text"), (900, None), (901, ""), (902, " \n "), (903, "x" * 200_000), (904, "\x00é😀"), (0, "again"), (0, "again")]
    frame = spark.createDataFrame([(d, t, "z", 1) for d, t in docs + odd], "doc_id bigint, text string, Quality string, score int")
    known = spark.createDataFrame([(d, q, t) for d, q, t in labels] + [(None, 1, 0), (5, None, 0), (6, 7, None), (7, 1, 0), (7, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = Q.quality_scores(frame, known).collect()
    assert len(got) == len(docs) + len(odd) and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [False]
    for kinds, share in (([], 0.5), ([(0, 1, 0), (1, 1, 0), (2, 1, 0)], 1.0)):
        few = Q.quality_scores(frame, spark.createDataFrame(kinds, "doc_id bigint, quality int, toxic int")).collect()
        assert {r.score for r in few} == {share}
    assert Q.quality_scores(frame.limit(0), known).collect() == []


def test_isotonic_and_solver():
    at, n = np.arange(6.0), np.full(6, 10)
    ends, levels = Q.isotonic(at, np.array([1, 3, 2, 8, 7, 10]), n)
    assert (np.diff(levels) >= 0).all() and (np.diff(ends) > 0).all()
    rng = np.random.default_rng(0)
    a = rng.normal(size=(30, 30))
    a, b = a @ a.T + np.eye(30), rng.normal(size=30)
    assert np.allclose(a @ Q.solve(a, b), b)


def test_statistics_are_finite():
    for t in (None, b"", b" ", b"\n\n", b"a", "é😀 \xa0".encode(), b"\xff\xfe"):
        s = Q.statistics(t)
        assert len(s) == len(Q.NAMES) and np.isfinite(s).all()


def test_normal_equations_and_ridge_by_hand(spark):
    """The distributed sums are those of all labelled rows, and the fitted weights solve them."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words, rng.integers(1, 80))) + ("!!" * int(rng.integers(0, 3)))) for i in range(400)]
    labels = [(i, int(rng.random() < 0.5)) for i in range(400)]
    settings = Q.Settings(features=20, combine=3)
    stats = Q.document_statistics(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(5))
    model = Q.fit(stats, spark.createDataFrame(labels, "doc_id bigint, quality int"), settings)
    kept = {r.doc_id: np.array(r.stats) for r in stats.collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 4 for i, _ in docs}
    x = model.features(np.array([kept[i] for i, _ in labels if fold[i] not in (2, 3)], dtype=np.float64))
    y = np.array([q for i, q in labels if fold[i] not in (2, 3)]) - 0.5
    rows = stats.join(spark.createDataFrame(labels, "doc_id bigint, quality int"), "doc_id").where("pmod(crc32(CAST(doc_id AS STRING)), 4) IN (0, 1)")
    a, b = Q._equations(rows, model, settings)
    assert np.allclose(a, x.T @ x) and np.allclose(b, x.T @ y)
    ridge = settings.ridge * max(1.0, a[0, 0]) / len(a) * np.eye(len(a))
    assert np.allclose(model.weights, np.linalg.solve(a + ridge, b))
    everything = np.array(list(kept.values()))
    assert np.allclose(model.mean, everything.mean(axis=0)) and np.allclose(model.scale, np.where(everything.std(axis=0) > 1e-9, everything.std(axis=0), 1))


def test_random_features_approximate_the_kernel():
    rng = np.random.default_rng(4)
    d, n = len(Q.NAMES), 20_000
    model = Q.Model(np.zeros(d), np.ones(d), rng.normal(size=(d, n)) / 4.0, rng.uniform(0, 2 * np.pi, n), np.zeros(0))
    z = rng.normal(size=(6, d))
    wave = model.features(z)[:, 1 + d :]
    want = np.exp(-((z[:, None] - z[None]) ** 2).sum(axis=2) / (2 * 4.0**2))
    assert np.abs(wave @ wave.T - want).max() < 0.05


@pytest.mark.parametrize("seed", range(5))
def test_isotonic_against_the_min_max_formula(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 30, 25)
    ones = rng.binomial(n, np.clip(np.linspace(0, 1, 25) + rng.normal(0, 0.3, 25), 0, 1))
    mean = lambda j, k: ones[j : k + 1].sum() / n[j : k + 1].sum()
    fitted = [max(min(mean(j, k) for k in range(i, 25)) for j in range(i + 1)) for i in range(25)]
    knots, levels = Q.isotonic(np.arange(25.0), ones, n)
    cut = np.flatnonzero(np.abs(np.diff(fitted)) > 1e-12) + 1
    blocks = np.split(np.arange(25), cut)
    share = np.maximum.accumulate([(ones[b].sum() + 0.5) / (n[b].sum() + 1) for b in blocks])
    assert np.allclose(levels[1:-1], share) and np.allclose(knots[1:-1], [(b * n[b]).sum() / n[b].sum() for b in blocks])
    assert (np.diff(knots) > 0).all() and (np.diff(levels) >= 0).all()
