"""Words of many texts as numpy arrays: where they are, and a 64-bit hash of each.

A text is looked at as UTF-8 bytes; a table of 256 entries says which bytes
belong to words. Both word classes in use take every byte from 0x80 up, so
that this agrees with the same class applied to code points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_CHUNK = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def byte_class(excluded: bytes) -> np.ndarray:
    out = np.ones(256, bool)
    out[np.frombuffer(excluded, np.uint8)] = False
    return out


#: [^\x20\x09-\x0D]+
NOT_SPACE = byte_class(b" \t\n\x0b\x0c\r")
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_OF_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)
_POWERS: np.ndarray | None = None
_INVERSE: np.ndarray | None = None


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """b^i and b^-i modulo 2^64 for i below n; b is odd."""
    global _POWERS, _INVERSE
    if _POWERS is None or len(_POWERS) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _POWERS = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, _BASE)])
            _INVERSE = np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, inverse)])
    return _POWERS, _INVERSE


@dataclass
class Words:
    buf: np.ndarray  # lower-cased bytes of all texts
    starts: np.ndarray  # of words, in buf
    ends: np.ndarray
    first: np.ndarray  # number of words before each text, and of all
    text_at: np.ndarray  # where each text starts in buf, and the end

    def hashes(self) -> np.ndarray:
        """A hash of each word's bytes; equal words have equal hashes."""
        out = np.empty(len(self.starts), np.uint64)
        at = 0
        while at < len(out):
            base = int(self.starts[at])
            upto = max(at + 1, int(np.searchsorted(self.ends, base + _CHUNK, side="right")))
            length = int(self.ends[upto - 1]) - base
            power, inverse = powers(max(length + 1, _CHUNK + 1))
            with np.errstate(over="ignore"):
                sums = np.zeros(length + 1, np.uint64)
                np.cumsum(_OF_BYTE[self.buf[base : base + length]] * power[:length], out=sums[1:])
                s, e = self.starts[at:upto] - base, self.ends[at:upto] - base
                out[at:upto] = mix((sums[e] - sums[s]) * inverse[s])
            at = upto
        return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts after each other, and where each starts; null: empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, at - at[0]


def words(column: pa.Array, kind: np.ndarray) -> Words:
    """The words of every text, after lower-casing A-Z; none crosses from text to text."""
    buf, at = text_bytes(column)
    buf = _LOWER[buf]
    inside = kind[buf]
    before = np.zeros(len(buf), bool)
    before[1:] = inside[:-1]
    before[at[:-1][at[:-1] < len(buf)]] = False
    after = np.zeros(len(buf), bool)
    after[:-1] = inside[1:]
    after[at[1:][at[1:] > 0] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return Words(buf, starts, ends, np.searchsorted(starts, at), at)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n neighbouring word hashes; the last n-1 positions are cut."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = h[: len(h) - n + 1].copy()
        for i in range(1, n):
            out = out * _BASE + h[i : len(h) - n + 1 + i]
    return mix(out)
