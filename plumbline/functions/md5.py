"""The first 32 bits of MD5 sums of many short messages at once, by numpy."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np

_K = [int(abs(math.sin(i + 1)) * (1 << 32)) & 0xFFFFFFFF for i in range(64)]
_TURN = [x for row in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for _ in range(4) for x in row]
_WORD = [*range(16), *((5 * i + 1) % 16 for i in range(16)), *((3 * i + 5) % 16 for i in range(16)), *(7 * i % 16 for i in range(16))]
#: So many messages take longer one by one than all at once.
FEW = 500
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _head(words: Sequence[np.ndarray | int], n: int) -> np.ndarray:
    """The sum's first four bytes, most significant first, of n blocks of 16 words; the last three steps do not reach them."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    f, t = np.empty(n, np.uint32), np.empty(n, np.uint32)
    for i in range(61):
        if i < 16:
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        w = words[_WORD[i]]
        if isinstance(w, np.ndarray):
            np.add(a, w, out=a), np.add(a, np.uint32(_K[i]), out=a)
        else:
            np.add(a, np.uint32((_K[i] + w) & 0xFFFFFFFF), out=a)
        np.left_shift(a, np.uint32(_TURN[i]), out=t), np.right_shift(a, np.uint32(32 - _TURN[i]), out=a)
        np.bitwise_or(a, t, out=a), np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(_START[0])).byteswap()


class Messages:
    """Keys of any length, for sums of prefix + key + suffix."""

    def __init__(self, keys: Sequence[bytes]):
        self.keys, sizes = keys, np.array([len(k) for k in keys], np.int64)
        self.groups = [(int(s), np.flatnonzero(sizes == s)) for s in np.unique(sizes)]
        self.bytes = {s: np.frombuffer(b"".join(keys[i] for i in at), np.uint8).reshape(len(at), s) for s, at in self.groups}
        self._words: dict[tuple[int, int], dict[int, np.ndarray]] = {}

    def _columns(self, size: int, start: int) -> dict[int, np.ndarray]:
        """The words that hold bytes of keys which begin at ``start``."""
        if (size, start) not in self._words:
            block = np.zeros((len(self.bytes[size]), 64), np.uint8)
            block[:, start : start + size] = self.bytes[size]
            words = block.view("<u4")
            self._words[size, start] = {j: np.ascontiguousarray(words[:, j]) for j in range(start // 4, -(-(start + size) // 4))} if size else {}
        return self._words[size, start]

    def heads(self, prefix: bytes, suffix: bytes) -> np.ndarray:
        """The first 32 bits of each sum, as the number that its first eight hexadecimal digits are."""
        out = np.empty(len(self.keys), np.uint32)
        for size, at in self.groups:
            total = len(prefix) + size + len(suffix)
            if total > 55 or len(at) < FEW:
                out[at] = [int.from_bytes(hashlib.md5(prefix + self.keys[i] + suffix).digest()[:4], "big") for i in at]
                continue
            fixed = (prefix + bytes(size) + suffix + b"\x80").ljust(56, b"\0") + (8 * total).to_bytes(8, "little")
            words: list = [int.from_bytes(fixed[4 * j : 4 * j + 4], "little") for j in range(16)]
            for j, column in self._columns(size, len(prefix)).items():
                words[j] = column | np.uint32(words[j]) if words[j] else column
            out[at] = _head(words, len(at))
        return out
