"""DuckDB expressions for the hashes that weights are made of, so that statements can draw the same ones."""

from __future__ import annotations

from plumbline.operators.statistics import POISSON_STEPS

P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5


def _u(n: int) -> str:
    return f"{n}::UHUGEINT"


def _times(x: str, n: int) -> str:
    return f"(({x}) * {_u(n)}) % {_u(1 << 64)}"


def _fold(x: str, shift: int) -> str:
    return f"xor({x}, {x} // {_u(1 << shift)})"


def _turn(x: str, by: int) -> str:
    return f"({_times(x, 1 << by)} + {x} // {_u(1 << (64 - by))})"


def xxhash64(source: str, column: str) -> str:
    """A query for ``column`` (BIGINT, not negative) and its Spark hash ``h`` from distinct rows of ``source``."""
    steps = [
        _times(f"{column}::UHUGEINT", P2), _times(_turn("h", 31), P1), f"xor({_u((42 + P5 + 8) % (1 << 64))}, h)", f"({_turn('h', 27)} * {_u(P1)} + {_u(P4)}) % {_u(1 << 64)}",
        _times(_fold("h", 33), P2), _times(_fold("h", 29), P3), _fold("h", 32),
    ]
    sql = source
    for step in steps:
        sql = f"(SELECT {column}, {step} AS h FROM {sql})"
    return sql


def _product(x: str, n: int) -> str:
    """x * n modulo 2 ** 64 in UBIGINT halves, which is faster than 128 bits; ``x`` is a column."""
    m, low, high = f"{0xFFFFFFFF}::UBIGINT", f"{n & 0xFFFFFFFF}::UBIGINT", f"{n >> 32}::UBIGINT"
    upper = f"((({x} & {m}) * {low}) >> 32) + ((({x} >> 32) * {low}) & {m}) + ((({x} & {m}) * {high}) & {m})"
    return f"(((({upper}) & {m}) << 32) | ((({x} & {m}) * {low}) & {m}))"


def poisson_weights(source: str, column: str, draws: int, seed: int = 0) -> str:
    """A query for ``column``, draw ``b`` and weight ``w``: what ``statistics.poisson_weights`` draws."""
    m = f"{0xFFFFFFFF}::UBIGINT"
    steps = f"(SELECT range::INTEGER AS b, ({_times(f'range::UHUGEINT + {_u((seed << 32) + 1)}', 0x9E3779B97F4A7C15)})::UBIGINT AS g FROM range({draws}))"
    added = f"((((h >> 32) + (g >> 32) + (((h & {m}) + (g & {m})) >> 32)) & {m}) << 32) | (((h & {m}) + (g & {m})) & {m})"
    z = f"(SELECT {column}, b, {added} AS z FROM (SELECT {column}, h::UBIGINT AS h FROM {xxhash64(source, column)}), {steps})"
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = f"(SELECT {column}, b, {_product('z', factor)} AS z FROM (SELECT {column}, b, xor(z, z >> {shift}) AS z FROM {z}))"
    u = f"(SELECT {column}, b, (xor(z, z >> 31) >> 11)::DOUBLE / 9007199254740992.0 AS u FROM {z})"
    return f"(SELECT {column}, b, {' + '.join(f'(u > {float(s)!r})::INT' for s in POISSON_STEPS)} AS w FROM {u})"
