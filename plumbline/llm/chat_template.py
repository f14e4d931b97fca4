"""Chat formatting by a template compiler.

A template is text with ``{{ expression }}`` and ``{% statement %}``. It is parsed into a syntax
tree, constants are folded (literals joined, constant tests decided, dead branches dropped), and the
tree becomes Python closures that yield the output piece by piece. Statements: ``for x in e`` /
``endfor`` with ``loop.index``, ``loop.index0`` and ``loop.first``; ``if`` / ``elif`` / ``else`` /
``endif``; ``set x = e``; ``generation`` / ``endgeneration``, which marks what a model should learn.
Expressions: literals, names, ``a.b`` and ``a['b']`` on mappings, ``not``, ``and``, ``or``,
comparisons, ``in``, ``+``, ``~`` and filters ``escape``, ``escape_line``, ``trim``, ``upper``, ``lower``, ``length``.

The language is a sandbox: it reaches only the mappings it is given, calls nothing but the named
filters, and loops only over what it is handed, so a template cannot run code or go on for ever.

Control strings inside texts are broken up by a backslash and backslashes are doubled, so that no
text can end or begin a turn and :func:`unescape` gives back every text.

Defined results for conversations: turns are ordered by turn, role and text, nulls first; a null
role or text is empty; a null conversation id is a conversation; repeated rows are turns of their
own; extra columns are ignored. Conversations are streamed turn by turn in sorted partitions, so
memory does not grow with their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type

from .common import only

CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
CHAT = (
    "{% for message in messages %}{{ '<|im_start|>' ~ (message.role | escape_line) ~ '\\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}{{ '<|im_end|>' ~ '\\n' }}{% endfor %}"
)
_HEAD = re.compile(r"(?:<\|im_start\|>)((?:[^\\\n]|\\.)*)\n", re.S)


def escape(text: str) -> str:
    """Double backslashes and put one behind the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def escape_line(text: str) -> str:
    """Escaped as one line: a backslash goes before each newline as well."""
    return escape(text).replace("\n", "\\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


class TemplateError(ValueError):
    """A template that the language does not allow."""


FILTERS: dict[str, Callable] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[<>+~|().\[\],=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


@dataclass(frozen=True)
class Node:
    """``kind`` with its parts; expressions and statements alike."""

    kind: str
    parts: tuple = ()


class _Expression:
    """Precedence climbing: or, and, not, comparison, sum, filter, access."""

    def __init__(self, source: str) -> None:
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            at = m.end()
            if m[1]:
                self.tokens.append(("text", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m[1][1:-1], flags=re.S)))
            elif m[2]:
                self.tokens.append(("number", int(m[2])))
            else:
                self.tokens.append(("name", m[3]) if m[3] else ("sign", m[4]))
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("name", "sign") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> str | None:
        if self.peek(*values):
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        found = self.tokens[self.at - 1][1]
        if found.startswith("_"):
            raise TemplateError(f"names may not begin with an underscore: {found}")
        return found

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", (node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = Node("and", (node, self.negated()))
        return node

    def negated(self) -> Node:
        return Node("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.summed()
        while sign := self.take("==", "!=", "<", ">", "<=", ">=", "in"):
            node = Node("compare", (sign, node, self.summed()))
        return node

    def summed(self) -> Node:
        node = self.filtered()
        while sign := self.take("+", "~"):
            node = Node("add" if sign == "+" else "join", (node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.reached()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            node = Node("filter", (name, node))
        return node

    def reached(self) -> Node:
        if self.take("("):
            node = self.either()
            self.need(")")
        elif self.at < len(self.tokens) and self.tokens[self.at][0] in ("text", "number"):
            node = Node("value", (self.tokens[self.at][1],))
            self.at += 1
        else:
            name = self.name()
            constant = {"true": True, "false": False, "none": None}
            node = Node("value", (constant[name],)) if name in constant else Node("name", (name,))
        while sign := self.take(".", "["):
            if sign == ".":
                node = Node("get", (node, Node("value", (self.name(),))))
            else:
                node = Node("get", (node, self.either()))
                self.need("]")
        return node


_PIECE = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)


def parse(template: str) -> Node:
    """The syntax tree of a template: a ``block`` of statements."""
    stack: list[tuple[str, list, list]] = [("", [], [])]  # opener, its heads and finished bodies, current body
    at = 0
    for m in _PIECE.finditer(template):
        if m.start() > at:
            stack[-1][2].append(Node("emit", (Node("value", (template[at : m.start()],)),)))
        at = m.end()
        if m[1] is not None:
            stack[-1][2].append(Node("emit", (_Expression(m[1]).whole(),)))
        elif m[2] is not None:
            _statement(m[2].strip(), stack)
    if at < len(template):
        stack[-1][2].append(Node("emit", (Node("value", (template[at:],)),)))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} is not closed")
    return Node("block", tuple(stack[0][2]))


def _statement(text: str, stack: list) -> None:
    word, _, rest = text.partition(" ")
    opener, heads, body = stack[-1]
    if word == "for":
        name, _, source = rest.partition(" in ")
        stack.append(("for", [_Expression(name).name(), _Expression(source).whole()], []))
    elif word == "if":
        stack.append(("if", [(_Expression(rest).whole(), [])], []))
        stack[-1] = ("if", stack[-1][1], stack[-1][1][0][1])
    elif word in ("elif", "else"):
        if opener != "if":
            raise TemplateError(f"{word!r} outside of 'if'")
        heads.append((_Expression(rest).whole() if word == "elif" else Node("value", (True,)), []))
        stack[-1] = ("if", heads, heads[-1][1])
    elif word == "generation":
        stack.append(("generation", [], []))
    elif word == "set":
        name, _, value = rest.partition("=")
        body.append(Node("set", (_Expression(name).name(), _Expression(value).whole())))
    elif word.startswith("end") and word[3:] == opener and opener:
        stack.pop()
        if opener == "for":
            node = Node("for", (*heads, Node("block", tuple(body))))
        elif opener == "if":
            node = Node("if", tuple((test, Node("block", tuple(b))) for test, b in heads))
        else:
            node = Node("generation", (Node("block", tuple(body)),))
        stack[-1][2].append(node)
    else:
        raise TemplateError(f"unexpected statement {text!r}")


_COMPARE: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}


def fold(node: Node) -> Node:
    """Evaluate constant expressions, decide constant tests and join neighbouring literals."""
    kind = node.kind
    if kind in ("value", "name"):
        return node
    if kind == "block":
        out: list[Node] = []
        for part in map(fold, node.parts):
            for p in part.parts if part.kind == "block" else (part,):
                if p.kind == "emit" and p.parts[0].kind == "value" and out and out[-1].kind == "emit" and out[-1].parts[0].kind == "value":
                    out[-1] = Node("emit", (Node("value", (_text(out[-1].parts[0].parts[0]) + _text(p.parts[0].parts[0]),)),))
                else:
                    out.append(p)
        return Node("block", tuple(out))
    if kind == "if":
        arms = []
        for test, body in node.parts:
            test = fold(test)
            if test.kind != "value":
                arms.append((test, fold(body)))
            elif test.parts[0]:
                arms.append((test, fold(body)))
                break
        if not arms:
            return Node("block")
        return arms[0][1] if arms[0][0].kind == "value" else Node("if", tuple(arms))
    parts = tuple(fold(p) if isinstance(p, Node) else p for p in node.parts)
    node = Node(kind, parts)
    if kind in ("or", "and", "not", "compare", "add", "join", "filter") and all(p.kind == "value" for p in parts if isinstance(p, Node)):
        return Node("value", (_closure(node)({}),))
    return node


def _text(value) -> str:
    return "" if value is None else str(value)


def _get(holder, key):
    if not isinstance(holder, dict):
        raise TemplateError("only mappings have members")
    return holder.get(key)


def _closure(node: Node) -> Callable[[dict], object]:
    """A function of the variables that gives an expression's value."""
    kind, p = node.kind, node.parts
    if kind == "value":
        value = p[0]
        return lambda v: value
    if kind == "name":
        name = p[0]
        return lambda v: v.get(name)
    if kind == "get":
        holder, key = map(_closure, p)
        return lambda v: _get(holder(v), key(v))
    if kind == "not":
        one = _closure(p[0])
        return lambda v: not one(v)
    if kind == "filter":
        apply, one = FILTERS[p[0]], _closure(p[1])
        return lambda v: apply(_text(one(v)))
    if kind == "compare":
        test, a, b = _COMPARE[p[0]], _closure(p[1]), _closure(p[2])
        return lambda v: test(a(v), b(v))
    a, b = map(_closure, p)
    if kind == "or":
        return lambda v: a(v) or b(v)
    if kind == "and":
        return lambda v: a(v) and b(v)
    if kind == "add":
        return lambda v: a(v) + b(v)
    return lambda v: _text(a(v)) + _text(b(v))


Piece = tuple[str, bool]


def _runner(node: Node, learn: bool = False) -> Callable[[dict], Iterator[Piece]]:
    """A generator function of the variables that yields (text, under the mask)."""
    kind, p = node.kind, node.parts
    if kind == "emit":
        value = _closure(p[0])

        def emit(v: dict) -> Iterator[Piece]:
            yield _text(value(v)), learn

        return emit
    if kind == "block":
        steps = [_runner(x, learn) for x in p]

        def block(v: dict) -> Iterator[Piece]:
            for step in steps:
                yield from step(v)

        return block
    if kind == "generation":
        return _runner(p[0], True)
    if kind == "set":
        name, value = p[0], _closure(p[1])

        def put(v: dict) -> Iterator[Piece]:
            v[name] = value(v)
            return iter(())

        return put
    if kind == "if":
        arms = [(_closure(test), _runner(body, learn)) for test, body in p]

        def choose(v: dict) -> Iterator[Piece]:
            for test, body in arms:
                if test(v):
                    yield from body(v)
                    return

        return choose
    name, source, body = p[0], _closure(p[1]), _runner(p[2], learn)

    def each(v: dict) -> Iterator[Piece]:
        for i, item in enumerate(source(v) or ()):
            yield from body({**v, name: item, "loop": {"index": i + 1, "index0": i, "first": i == 0}})

    return each


def compile_template(template: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from messages, which may be a stream, to pieces of (text, under the mask)."""
    run = _runner(fold(parse(template)))
    return lambda messages: run({"messages": messages})


class ReadBack:
    """Reads formatted pieces back: turns, their digest, and the text under the mask."""

    def __init__(self) -> None:
        self.buffer, self.turns, self.chars, self.loss_chars = "", 0, 0, 0
        self.turn_digest, self.loss_digest = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, learn: bool) -> None:
        self.chars += len(text)
        self.buffer += text
        if learn:
            plain = unescape(text)
            self.loss_chars += len(plain)
            self.loss_digest.update(plain.encode())
        while (end := self.buffer.find("<|im_end|>\n")) >= 0:
            turn, self.buffer = self.buffer[:end], self.buffer[end + len("<|im_end|>\n") :]
            head = _HEAD.match(turn)
            self.turns += 1
            self.turn_digest.update(f"{unescape(head[1])}\n{unescape(turn[head.end() :])}\n".encode())


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[dict]]]:
    """Runs of rows with one conversation id; each must be read before the next."""
    from itertools import groupby

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")])

    for conv, own in groupby(rows(), key=lambda r: r[0]):
        yield conv, ({"role": r[1] or "", "text": r[2] or ""} for r in own)


def _sorted(conversations: DataFrame) -> DataFrame:
    return only(conversations, "conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def format_conversations(conversations: DataFrame, template: str = CHAT) -> DataFrame:
    """conv_id, formatted text and learnt spans (start, end in code points) of each conversation.

    A formatted conversation is one value, so its length is bounded by a column's, 2 GB.
    """
    kind = only(conversations, "conv_id").schema[0].dataType
    arrow = to_arrow_type(kind)
    fold(parse(template))  # errors show here and not in a task

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for conv, messages in _by_conversation(batches):
            parts, spans, at = [], [], 0
            for text, learn in render(messages):
                if learn and text:
                    if spans and spans[-1][1] == at:
                        spans[-1][1] += len(text)
                    else:
                        spans.append([at, at + len(text)])
                parts.append(text)
                at += len(text)
            yield pa.RecordBatch.from_arrays(
                [pa.array([conv], arrow), pa.array(["".join(parts)], pa.string()), pa.array([[{"start": a, "end": b} for a, b in spans]], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                names=["conv_id", "formatted", "spans"],
            )

    return _sorted(conversations).mapInArrow(run, f"conv_id {kind.simpleString()}, formatted string, spans array<struct<start:bigint,end:bigint>>")


def format_report(conversations: DataFrame, template: str = CHAT) -> DataFrame:
    """Digests of each conversation, read back from its formatted form as that is produced."""
    kind = only(conversations, "conv_id").schema[0].dataType
    arrow = to_arrow_type(kind)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render, out = compile_template(template), []

        def batch() -> pa.RecordBatch:
            kinds = [arrow, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for conv, messages in _by_conversation(batches):
            back = ReadBack()
            for text, learn in render(messages):
                back.feed(text, learn)
            out.append((conv, back.turns, back.turn_digest.hexdigest(), back.loss_chars, back.loss_digest.hexdigest(), back.chars))
            if len(out) == 1000:
                yield batch()
                out.clear()
        if out:
            yield batch()

    schema = f"conv_id {kind.simpleString()}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return _sorted(conversations).mapInArrow(run, schema)
