import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import chat_template as C

SCHEMA = "conv_id bigint, turn bigint, role string, text string, extra string"


def expected(turns):
    all_, loss = hashlib.sha256(), hashlib.sha256()
    n = 0
    for role, text in turns:
        all_.update(f"{role}\n{text}\n".encode())
        if role == "assistant":
            loss.update(text.encode())
            n += len(text)
    return len(turns), all_.hexdigest(), n, loss.hexdigest()


def read_back(turns, template=C.CHAT):
    back = C.ReadBack()
    for piece in C.compile_template(template)([{"role": r, "text": t} for r, t in turns]):
        back.feed(*piece)
    return back.turns, back.turn_digest.hexdigest(), back.loss_chars, back.loss_digest.hexdigest()


hard = st.lists(st.sampled_from([*C.CONTROL, "\\", "\n", "<", "|", "im_end|>", ">", "a", "[", "é", "😀", "/s>"]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant"]), hard), hard), max_size=6))
@settings(max_examples=300, deadline=None)
def test_every_text_comes_back(turns):
    assert read_back(turns) == expected(turns)


@given(hard)
@settings(deadline=None)
def test_no_control_string_survives(text):
    assert not any(c in C.escape(text) for c in C.CONTROL)
    assert C.unescape(C.escape(text)) == text


def text_of(template, messages=()):
    return "".join(t for t, _ in C.compile_template(template)(messages))


def test_language():
    m = [{"role": "user", "text": " Hi "}, {"role": "assistant", "text": "Yo"}]
    assert text_of("{% for x in messages %}{% if loop.first %}^{% elif x.role == 'assistant' %}>{% else %}?{% endif %}{{ x['text'] | trim }}{% endfor %}$", m) == "^Hi>Yo$"
    assert text_of("{% set a = 'x' ~ 1 %}{{ a + 'y' }}{# note #}{{ 'a' in 'abc' and not false }}") == "x1yTrue"


def test_folding():
    assert C.fold(C.parse("a{{ 'b' ~ 'c' }}{% if 1 == 2 %}no{% else %}d{% endif %}")) == C.Node("block", (C.Node("emit", (C.Node("value", ("abcd",)),)),))


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ f(1) }}", "{{ x | nope }}", "{% for x in y %}", "{% endif %}", "{% import os %}", "{{ 'a' $ }}"])
def test_sandbox(bad):
    with pytest.raises(C.TemplateError):
        C.compile_template(bad)


def test_members_of_mappings_only():
    with pytest.raises(C.TemplateError):
        text_of("{% set a = 'text' %}{{ a.upper }}")


def test_report(spark):
    rows = [(1, 1, "assistant", "b", "x"), (1, 0, "user", "</s>[INST]", "y"), (2, None, None, None, None), (2, 0, "assistant", "", None), (None, 0, "user", "\\n\n", None), (None, 0, "user", "\\n\n", None)]
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.format_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: expected([("user", "</s>[INST]"), ("assistant", "b")]), 2: expected([("", ""), ("assistant", "")]), None: expected([("user", "\\n\n")] * 2)}
    assert C.format_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_formatted(spark):
    out = C.format_conversations(spark.createDataFrame([(1, 0, "user", "q", ""), (1, 1, "assistant", "ans<s>", "")], SCHEMA)).first()
    assert out.formatted == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\nans<\\s><|im_end|>\n"
    assert [out.formatted[s.start : s.end] for s in out.spans] == ["ans<\\s>"]


@pytest.mark.parametrize("kind", ["string", "smallint", "int", "bigint"])
def test_ids_of_any_type_and_none(spark, kind):
    one = "a" if kind == "string" else 1
    rows = [(one, 0, "user", "q"), (one, 1, "assistant", None), (None, 0, "assistant", "x"), (None, 1, None, "")]
    turns = spark.createDataFrame(rows, f"conv_id {kind}, turn int, role string, text string")
    want = {one: expected([("user", "q"), ("assistant", "")]), None: expected([("assistant", "x"), ("", "")])}
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in C.format_report(turns).collect()} == want
    made = C.format_conversations(turns)
    assert made.schema["conv_id"].dataType == turns.schema["conv_id"].dataType
    assert {r.conv_id: [r.formatted[s.start : s.end] for s in r.spans] for r in made.collect()} == {one: [], None: ["x"]}
