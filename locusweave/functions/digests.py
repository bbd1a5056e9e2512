"""Heads of MD5 digests of many texts at a time, for draws that any engine can repeat."""

from __future__ import annotations

import math

import numpy as np

_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = tuple(np.uint32(v) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))


def _round(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, ...]:
    """One block of every text: ``words`` is 16 rows of 32-bit numbers."""
    old, (a, b, c, d) = (a, b, c, d), (v.copy() for v in (a, b, c, d))
    f, g = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        turn = i // 16
        if turn == 0:
            at = i
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif turn == 1:
            at = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif turn == 2:
            at = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            at = 7 * i % 16
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        a += f
        a += words[at] + _SINES[i]
        left = _TURNS[turn][i % 4]
        np.left_shift(a, np.uint32(left), out=f), np.right_shift(a, np.uint32(32 - left), out=g), np.bitwise_or(f, g, out=f)
        f += b
        a, b, c, d, f = d, f, b, c, a
    return tuple(x + y for x, y in zip(old, (a, b, c, d)))


class Heads:
    """The first 48 bits of MD5(prefix + text) of fixed texts under many prefixes; texts are laid out once for each length of prefix."""

    def __init__(self, texts: list[bytes]) -> None:
        self._texts, self._laid = texts, {}

    def _layout(self, at: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Texts that need the same number of blocks: their places, and their words behind ``at`` free bytes."""
        blocks = np.array([(at + len(t) + 8) // 64 + 1 for t in self._texts])
        found = []
        for n in np.unique(blocks):
            where = np.flatnonzero(blocks == n)
            padded = b"".join((b"\0" * at + t + b"\x80").ljust(64 * n - 8, b"\0") + (8 * (at + len(t))).to_bytes(8, "little") for t in (self._texts[i] for i in where))
            found.append((where, np.ascontiguousarray(np.frombuffer(padded, "<u4").reshape(len(where), 16 * n).T)))
        return found

    def __call__(self, prefixes: list[bytes]) -> np.ndarray:
        """A row for each prefix, all of one length."""
        size = len(prefixes[0])
        if size not in self._laid:
            self._laid = {size: self._layout(size)}
        out = np.empty((len(prefixes), len(self._texts)), np.uint64)
        width = -(-size // 4) * 4
        head = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in prefixes), "<u4").reshape(len(prefixes), -1).T[:, :, None]
        for where, words in self._laid[size]:
            state = tuple(np.full((len(prefixes), len(where)), v) for v in _START)
            for block in range(0, len(words), 16):
                own = list(words[block:block + 16])
                for i, part in enumerate(head[block:block + 16]):
                    own[i] = own[i] | part
                state = _round(*state, own)
            first, second = (state[i].byteswap().astype(np.uint64) for i in (0, 1))
            out[:, where] = first << np.uint64(16) | second >> np.uint64(16)
        return out
