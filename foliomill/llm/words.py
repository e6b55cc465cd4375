"""Words and their hashes over whole batches of texts, in numpy."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
CHUNK = 1 << 20


@functools.cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give freed memory back at the end of a task: reused workers would keep it while other operators run."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over 64 output bits."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def chunks(texts: list[bytes] | list[str], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes (or characters); a longer text stands alone."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


class Hasher:
    """64-bit hash of each word: a polynomial over random values of its bytes, then mixed."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, 2**64, 256, dtype=U)
        self.base = int(rng.integers(0, 2**63)) * 2 + 1
        self.inverse = pow(self.base, -1, 2**64)
        self.steps = [pow(int(rng.integers(0, 2**63)) * 2 + 1, 1, 2**64) for _ in range(1)]
        self.up = self.down = np.empty(0, U)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            m = max(n, CHUNK + 1024)
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(m, b, U)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=U))

    def words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(buf)
        self._powers(n + 1)
        total = np.zeros(n + 1, U)
        np.cumsum(self.values[buf] * self.up[:n], dtype=U, out=total[1:])
        return mix((total[ends] - total[starts]) * self.down[starts] + (ends - starts).astype(U))

    def sequences(self, hashes: np.ndarray, k: int) -> np.ndarray:
        """Hash of each k consecutive words; empty if there are fewer."""
        n = len(hashes) - k + 1
        if n <= 0:
            return np.empty(0, U)
        out, c = hashes[:n].copy(), self.steps[0]
        for i in range(1, k):
            out += hashes[i : n + i] * U(c)
            c = c * self.steps[0] % 2**64
        return mix(out)


class Words:
    """Words [^\\x20\\x09-\\x0D]+ of texts laid end to end; doc[i] is the text of word i."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(joined.lower() if lower else joined, np.uint8)
        gap = (self.buf == 32) | ((self.buf - np.uint8(9)) <= 4)
        turn = np.flatnonzero(np.diff(gap, prepend=True))
        self.starts, self.ends = turn[0::2], turn[1::2]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.doc = np.searchsorted(first, self.starts, "right") - 1
        self.bounds = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def whole(self, k: int) -> np.ndarray:
        """For each k consecutive words, whether they lie in one text."""
        n = len(self.doc) - k + 1
        return self.doc[:n] == self.doc[k - 1 :] if n > 0 else np.empty(0, bool)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each width consecutive values."""
    if len(x) < width:
        return x[:0]
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
