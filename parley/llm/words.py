"""Words of a text as the operators see them: A-Z lower-cased, then runs of ASCII letters, digits and non-ASCII characters.

On UTF-8 bytes that is one table look-up per byte, as every byte of a non-ASCII character is 0x80 or more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = 32
#: Bytes hashed at once. A longer text is hashed piece by piece.
BLOCK = 1 << 20
_P = 0x9E3779B97F4A7C15


def _table() -> bytes:
    keep = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in keep else SPACE for b in range(256))


TABLE = _table()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: a bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hasher:
    """64-bit hashes of words by differences of prefix sums of ``code[byte] * P**position``."""

    def __init__(self, table: bytes = TABLE):
        self.table = table
        self.code = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_P))
        self.power = self.inverse = np.ones(0, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.power):
            n = max(n, BLOCK)
            back = pow(_P, -1, 1 << 64)
            with np.errstate(over="ignore"):
                self.power = np.multiply.accumulate(np.full(n, _P, np.uint64))
                self.inverse = np.multiply.accumulate(np.full(n, back, np.uint64))

    def block(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of one piece, and where each begins."""
        a = np.frombuffer(data.translate(self.table), np.uint8)
        self._grow(len(a))
        inside = np.zeros(len(a) + 2, np.int8)
        inside[1:-1] = a != SPACE
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(a) + 1, np.uint64)
            np.cumsum(self.code[a] * self.power[: len(a)], out=sums[1:])
            return mix((sums[ends] - sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64)), starts

    def long(self, data: bytes) -> np.ndarray:
        """Hashes of the words of a text of any length, cut into pieces between words."""
        out, at = [], 0
        while at < len(data):
            end = at + BLOCK
            while end < len(data) and self.table[data[end]] != SPACE:
                end += 1
            out.append(self.block(data[at:end])[0])
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def texts(self, texts: list[bytes | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For runs of texts: index of the first, hashes of all their words, and each text's offset among these, with the end."""
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or b"") < BLOCK):
                size += len(texts[j] or b"") + 1
                j += 1
            if size > BLOCK and j == i + 1:
                hashes = self.long(texts[i])
                yield i, hashes, np.array([0, len(hashes)])
            else:
                own = [x or b"" for x in texts[i:j]]
                hashes, starts = self.block(b" ".join(own))
                begins = np.cumsum([0] + [len(x) + 1 for x in own])
                yield i, hashes, np.searchsorted(starts, begins)
            i = j


def ngrams(hashes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every k consecutive words within a text, and each text's offset among them."""
    n = max(0, len(hashes) - k + 1)
    with np.errstate(over="ignore"):
        g = hashes[:n].copy()
        for i in range(1, k):
            g = g * np.uint64(0x100000001B3) + hashes[i : i + n]
        g = mix(g)
    sizes = np.maximum(0, np.diff(offsets) - (k - 1))
    keep = np.zeros(n + 1, np.int32)
    some = sizes > 0
    np.add.at(keep, offsets[:-1][some], 1)
    np.add.at(keep, offsets[:-1][some] + sizes[some], -1)
    return g[np.cumsum(keep[:n]) > 0], np.concatenate([[0], np.cumsum(sizes)])
