"""Extra columns whose names clash with those of the operators."""

import public_tokenizers
import pytest

from plumbline.llm import archives, chat_template, packing, positional_index, quality, repetition, secret_spans, sharding, simhash, suffix_repeats

NAMES = ["doc_id", "text", "TEXT", "Doc_Id", "n_chars", "node", "bin", "part", "size", "shard", "slot", "n", "class_id", "stats", "score", "key", "found"]
TEXT = " ".join(f"word{i}" for i in range(45))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, TEXT, "other", 99, 5, *["x"] * 12), (2, TEXT + " token=abcdefgh", None, None, None, *[None] * 12)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, c2 string, c3 bigint, c4 bigint, " + ", ".join(f"c{i} string" for i in range(5, 17))).toDF(*NAMES)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(7, "nothing like it at all", "x", 1)], "item_id bigint, text string, a string, b bigint").toDF("item_id", "text", "Text", "ITEM_ID")


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_reports(spark, docs, items):
    labels = spark.createDataFrame([(1, 1, 5), (2, 0, 6)], "doc_id bigint, quality int, c int").toDF("doc_id", "quality", "DOC_ID")
    made = [
        quality.quality_scores(docs, labels), packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")).select("doc_id").distinct(), simhash.near_duplicates(docs),
        repetition.repetition_report(docs), positional_index.contamination_report(docs, items), secret_spans.secret_report(docs), sharding.assign_shards(docs, 4),
    ]
    assert all(ids(m) == [1, 2] for m in made)
    assert suffix_repeats.repeated_passages(docs).collect() == []
    turns = spark.createDataFrame([(1, 0, "user", "hi", "x")], "conv_id bigint, turn bigint, role string, text string, e string").toDF("conv_id", "turn", "role", "text", "Conv_ID")
    assert chat_template.format_report(turns).first().n_turns == 1
    pages = spark.createDataFrame([(1, "u", "h", "x")], "page_id bigint, url string, html string, e string").toDF("page_id", "url", "html", "HTML")
    assert archives.archive_pages(pages).first().record_type == "response"


def test_stages(docs, items):
    for out, n in ((repetition.keep_documents(docs), 2), (positional_index.drop_contaminated(docs, items), 2), (secret_spans.mask_secrets(docs), 2), (simhash.keep_one_of_each(docs), 1)):
        assert out.columns == NAMES and len(out.collect()) == n
    out = sharding.shard_documents(docs, 3)
    assert out.columns == [*NAMES, "shard"] and len(out.collect()) == 2
