"""Words of Arrow text columns and 64-bit fingerprints of word runs, computed over whole batches in numpy.

Word bounds are bytes of UTF-8, which is exact because every separator is ASCII. The fingerprint of bytes [s, e) is
sum(byte[i] * P**(i - s)) mod 2**64 from one prefix sum (P is odd, so powers have inverses), then mixed. Modulo a power of two there
are long strings that agree whatever P is (those of Thue and Morse), so words beyond LONG bytes have a cryptographic hash instead."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACED = np.ones(256, dtype=bool)  # words are runs of all but white space
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, dtype=bool)  # words are runs of digits, lower-case letters and bytes beyond ASCII
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LONG = 32  # bytes of a word up to which the polynomial is its fingerprint
SLICE = 512 << 10  # bytes of text worked on at once, or one text


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


class Powers:
    """base**i and base**-i mod 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 1 << 16)
            grow = lambda b: np.multiply.accumulate(np.concatenate([np.ones(1, dtype=U), np.full(n - 1, b, dtype=U)]))
            self.up, self.down = grow(self.base), grow(self.inverse)
        return self.up, self.down


BYTES, WORDS = Powers(0x9E3779B97F4A7C15), Powers(0xD6E8FEB86659FD93)


@dataclass
class Words:
    data: np.ndarray  # bytes, lower-cased if asked for
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray  # words of text d are of[d] : of[d + 1]

    def hashes(self) -> np.ndarray:
        """A fingerprint of each word."""
        up, down = BYTES.upto(len(self.data) + 1)
        sums = np.zeros(len(self.data) + 1, dtype=U)
        np.cumsum((self.data.astype(U) + U(1)) * up[: len(self.data)], out=sums[1:])
        out = mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(U) * U(0x2545F4914F6CDD1D))
        for i in np.flatnonzero(self.ends - self.starts > LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i] : self.ends[i]], digest_size=8).digest(), "little")
        return out

    def text_of(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.of) - 1), np.diff(self.of))

    def starts_of_runs(self, k: int) -> np.ndarray:
        """First words of all runs of k words within one text."""
        return np.flatnonzero(np.arange(len(self.starts)) + k <= self.of[1:][self.text_of()])

    def runs(self, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all runs of k words within one text, and the runs' fingerprints."""
        at = self.starts_of_runs(k)
        return (at, combine(hashes, at, k)) if len(at) else (at, np.zeros(0, dtype=U))

    def joined(self, d: int) -> bytes:
        """The words of text d, joined by a space."""
        s, e = int(self.of[d]), int(self.of[d + 1])
        return b" ".join(self.data[self.starts[s] : self.ends[e - 1]].tobytes().split()) if e > s else b""

    def text(self, i: int, k: int) -> bytes:
        """The k words from the i-th on, joined by a space."""
        return b" ".join(self.data[self.starts[i] : self.ends[i + k - 1]].tobytes().split())

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def combine(hashes: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of the runs of k words from each of ``at``."""
    up, down = WORDS.upto(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, dtype=U)
    np.cumsum(hashes * up[: len(hashes)], out=sums[1:])
    return mix((sums[at + k] - sums[at]) * down[at] + U(k))


def find(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool) -> Words:
    if lower:
        data = LOWER[data]
    inside = table[data]
    before = np.zeros(len(data), dtype=bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = inside[1:]
    edges = offsets[:-1][np.diff(offsets) > 0]
    before[edges] = False
    after[edges[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def slices(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A text column in parts of about ``limit`` bytes: first row, bytes, offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        own = offsets[first : last + 1]
        yield first, data[own[0] : own[-1]], own - own[0]
        first = last


def split(text: bytes, lower: bool = False) -> list[bytes]:
    """The words of one text between white space: what bytes.split() divides at is just what SPACED does."""
    return (text.lower() if lower else text).split()


HELD: list[dict] = []  # what operators keep in a Python worker from task to task


def forget() -> None:
    """Drop what another operator has left in this worker, which outlives its stage."""
    for kept in HELD:
        kept.clear()
    release()


def release() -> None:
    """Give freed memory back to the system: a Python worker outlives its task, and idles beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    if hasattr(ctypes.CDLL(None), "malloc_trim"):
        ctypes.CDLL(None).malloc_trim(0)


def releasing(fn: Callable) -> Callable:
    """A function of groups that gives back what it has freed. Spark counts a function's arguments, so they are spelt out."""

    def last(out: pa.Table) -> pa.Table:
        release()
        return out

    if fn.__code__.co_argcount == 1:
        return lambda a: last(fn(a))
    if fn.__code__.co_argcount == 2:
        return lambda a, b: last(fn(a, b))
    return lambda a, b, c: last(fn(a, b, c))


def freeing(fn: Callable) -> Callable:
    """A function of batches that drops what another operator has left in its worker, and gives back at its end what it has freed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        yield from fn(batches)
        release()

    return run
