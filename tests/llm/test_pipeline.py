"""The corpus pipeline against the same decisions taken in plain Python."""

import random
import re
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from plumbline.llm import queries, repetition
from plumbline.llm.common import join_spread

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(2000)]
    bench = [(i, " ".join(rng.choices(vocabulary, k=25))) for i in range(5)]
    texts = [None, "", "too short"]
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.choice([30, 80, 300]))
        if i % 7 == 0:
            words = words[:10] * 6
        if i % 5 == 1:
            words[4:4] = bench[i % 5][1].split()
        if i % 6 == 2:
            words[3:3] = ["password=hunter2222"]
        texts.append(" ".join(words))
        if i % 4 == 3:
            words[len(words) // 2] = "changed"
            texts.append(" ".join(words) if len(words) > 80 else texts[-1])
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], bench


def shingles(t):
    w = t.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def by_hand(rows, bench):
    kept = {}
    for d, t, *_ in rows:
        c = repetition.measure([t.encode() if t else None], repetition.Limits(), repetition._Words())
        if repetition.verdict(c, repetition.Limits())[1][0]:
            kept[d] = t
    least = {}
    for d in sorted(kept):
        near = [e for e in least if len(a := shingles(kept[d]) & shingles(kept[e])) >= 0.8 * (len(shingles(kept[d])) + len(shingles(kept[e])) - len(a))]
        least[d] = least[near[0]] if near else d
    kept = {d: t for d, t in kept.items() if least[d] == d}
    windows = {tuple(w[i : i + 10]) for _, t in bench for w in [t.split()] for i in range(len(w) - 9)}
    fold = lambda t: re.findall("[a-z0-9]+", t.lower())
    kept = {d: t for d, t in kept.items() if not any(tuple(fold(t)[i : i + 10]) in windows for i in range(len(fold(t)) - 9))}
    return {d: t.replace("password=hunter2222", "[SECRET]") for d, t in kept.items()}


def test_pipeline(spark, tmp_path):
    rows, bench = corpus()
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = by_hand(rows, bench)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert {r.doc_id: r.text for r in docs.collect()} == want
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total = defaultdict(int)
    for r in out:
        total[r.doc_id] += r.length
    assert dict(total) == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in want.items()}


def test_stages_take_odd_rows(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "x " * 30, None, None, 1), (7, "same words " + " ".join(map(str, range(40))), "en", "s", 5), (7, "same words " + " ".join(map(str, range(40))), "en", "s", 5)]
    spark.createDataFrame([(None, None), (1, "")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for some in (rows, []):
        docs = spark.createDataFrame([(*r, "extra") for r in some], SCHEMA + ", Size string")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns[-1] == "Size"
        assert [r.doc_id for r in docs.collect()] == ([7] if some else [])


def test_names():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontaminate", "secrets", "pack"]


def test_join_of_hot_keys(spark):
    left = spark.createDataFrame([(i, 0 if i % 3 == 0 else i) for i in range(5000)], "i int, k int")
    right = left.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "k * 2 AS v")
    assert join_spread(left, right, "k", 5000).selectExpr("sum(v) AS s", "count(*) AS n").first() == (int(np.sum([2 * (0 if i % 3 == 0 else i) for i in range(5000)])), 5000)
    some = right.where("k > 2500 OR k = 0")
    out = join_spread(left, some, "k", 5000, "left")
    assert out.count() == 5000 and out.where("v IS NULL").count() == left.where("k > 0 AND k <= 2500").count()
