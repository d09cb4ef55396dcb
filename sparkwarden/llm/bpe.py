"""Byte-level BPE by merge replay over the distinct words of a corpus block.

Every distinct word of a block of documents becomes a linked run of symbols in
one array. An inverted index takes each adjacent token pair (by the rank of
what it merges to) to its positions; the lowest rank is replayed at all its
positions at once, and only the two neighbours of each merge enter the index
anew. Words are coded once a block, and a worker keeps what it has coded, so
that the corpus costs one dictionary look-up a word.

A block is bounded (BLOCK_BYTES of text, or one longer document), so memory doesn't depend
on the corpus, nothing is shuffled, and a lost task repeats only its own rows.

Equal ranks inside a word merge from the left, and a pair that appears with a
lower rank than the current one goes first, as in the reference library.

Defined results: null and empty texts have no tokens. Rows come back one for
each input row, repeated rows included. Other columns are not read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import common

#: White_Space of Unicode, as the pattern's \s means it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A run of white space with what follows: the pattern never matches across these units.
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Text bytes of a block.
BLOCK_BYTES = 8 << 20
#: Units whose ids a worker keeps; beyond it, it forgets those not met since it last forgot.
KEEP_UNITS = 250_000
_NONE = np.iinfo(np.int32).max


class Ranks:
    """A vocabulary of byte strings with ranks, and the table of its merges."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
        self.token = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.text = [str(r) for r in range(len(self.token))]
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = sorted((ranks[t[:i]] << 32 | ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.made = np.array([r for _, r in pairs], np.int32)
        self.bytes_made = self.rank(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)).reshape(256, 256)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The token each pair merges to, or _NONE."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.made[at], _NONE)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(2)
def ranks_at(path: str) -> Ranks:
    return Ranks(path)


def _without_overlap(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of ascending positions, those left when merging from the left eats each one's successor."""
    if len(at) < 2:
        return at
    follows = np.zeros(len(at), bool)
    follows[1:] = after[at[:-1]] == at[1:]
    if not follows.any():
        return at
    i = np.arange(len(at))
    head = np.maximum.accumulate(np.where(follows, 0, i))
    return at[(i - head) % 2 == 0]


def replay(words: list[bytes], v: Ranks) -> list[tuple[int, ...]]:
    """The ids of each word, by one pass over the ranks that occur."""
    if not words:
        return []
    raw = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    n = len(raw)
    sym = v.of_byte[raw]
    word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(ends, prepend=0))
    after = np.arange(1, n + 1, dtype=np.int64)
    after[ends - 1] = n  # n: none
    before = np.arange(-1, n - 1, dtype=np.int64)
    before[np.r_[0, ends[:-1]]] = n
    pair = np.full(n + 1, _NONE, np.int32)  # rank of a symbol with its successor
    pair[: n - 1] = v.bytes_made[raw[:-1], raw[1:]]
    pair[ends - 1] = _NONE
    sym = np.append(sym, np.int32(-1))

    index: dict[int, list[np.ndarray]] = {}
    live = np.flatnonzero(pair[:n] != _NONE)
    live = live[np.argsort(pair[live], kind="stable")]
    cuts = np.flatnonzero(np.diff(pair[live], prepend=-1))
    for a, b in zip(cuts, np.append(cuts[1:], len(live)), strict=bool(len(cuts))):
        index[int(pair[live[a]])] = [live[a:b]]
    heap = sorted(index)
    mark = np.zeros(n + 1, bool)

    def marked(positions: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of ``at`` are among ``positions``."""
        mark[positions] = True
        out = mark[at]
        mark[positions] = False
        return out

    def ascending(x: np.ndarray) -> np.ndarray:
        """Distinct positions in order."""
        x = np.sort(x)
        keep = np.ones(len(x), bool)
        np.not_equal(x[1:], x[:-1], out=keep[1:])
        return x[keep]

    def add(positions: np.ndarray) -> None:
        r = pair[positions]
        positions, r = positions[r != _NONE], r[r != _NONE]
        if not len(r):
            return
        order = np.argsort(r, kind="stable")
        positions, r = positions[order], r[order]
        cut = np.flatnonzero(np.diff(r, prepend=-1)).tolist()
        for a, b in zip(cut, [*cut[1:], len(r)], strict=True):
            k = int(r[a])
            if k in index:
                index[k].append(positions[a:b])
            else:
                index[k] = [positions[a:b]]
                heapq.heappush(heap, k)

    while heap:
        rank = heapq.heappop(heap)
        parts = index.pop(rank)
        at = parts[0] if len(parts) == 1 else ascending(np.concatenate(parts))
        at = at[pair[at] == rank]
        if not len(at):
            continue
        take = _without_overlap(at, after)
        right = after[take]
        prior, made = before[take], np.full(len(take), rank)
        new_left = v.rank(np.where(marked(right, prior), rank, sym[prior]), made)
        new_right = v.rank(made, sym[after[right]])
        if (new_left < rank).any() or (new_right < rank).any():  # a lower rank appears: one merge a word, then look again
            first = np.ones(len(at), bool)
            first[1:] = word[at[1:]] != word[at[:-1]]
            index[rank] = [at[~first]]
            if len(index[rank][0]):
                heapq.heappush(heap, rank)
            else:
                del index[rank]
            take = at[first]
            right = after[take]
        elif len(take) < len(at):  # what overlapped may be a pair again
            rest = at[~marked(take, at) & ~marked(right, at)]
            if len(rest):
                index.setdefault(rank, []).append(rest)
                heapq.heappush(heap, rank)
        sym[take] = rank
        beyond = after[right]
        after[take] = beyond
        has = beyond < n
        before[beyond[has]] = take[has]
        sym[right] = -1
        pair[right] = _NONE
        pair[take] = np.where(has, v.rank(sym[take], sym[beyond]), _NONE)
        prior = before[take]
        prior = prior[(prior >= 0) & (prior < n)]
        pair[prior] = v.rank(sym[prior], sym[after[prior]])
        add(ascending(np.concatenate([take, prior])))
    kept = np.flatnonzero(sym[:n] >= 0)
    ids = sym[kept].tolist()
    cut = np.searchsorted(kept, ends).tolist()
    return [tuple(ids[a:b]) for a, b in zip([0, *cut[:-1]], cut, strict=True)]


class Coder:
    """Encodes texts block by block and keeps the ids of units it has met."""

    def __init__(self, path: str, pattern: str, keep_units: int = KEEP_UNITS):
        self.keep_units = keep_units
        self.v, self.split = ranks_at(path), regex.compile(pattern)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def learn(self, units: set[str]) -> None:
        if len(self.known) > self.keep_units:
            self.known, self.older = {}, self.known
        new = []
        for u in units.difference(self.known):
            ids = self.older.get(u)
            if ids is None:
                new.append(u)
            else:
                self.known[u] = ids
        find, number, at, pieces = self.split.findall, {}, [], []
        for u in new:
            words = find(u)
            at.append(len(words))
            pieces += [number.setdefault(w, len(number)) for w in words]
        ids, i = replay([w.encode() for w in number], self.v), 0
        for u, k in zip(new, at, strict=True):
            self.known[u] = ids[pieces[i]] if k == 1 else tuple(chain.from_iterable([ids[p] for p in pieces[i : i + k]]))
            i += k

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        collecting = gc.isenabled()
        gc.disable()  # nothing here has cycles, and the many tuples are slow to look through
        try:
            cut = [UNIT.findall(t) for t in texts]
            units: set[str] = set()
            for c in cut:
                units.update(c)
            self.learn(units)
        finally:
            if collecting:
                gc.enable()
        of = self.known.__getitem__
        for c in cut:
            yield list(chain.from_iterable(map(of, c)))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True, block_bytes: int = BLOCK_BYTES, keep_units: int = KEEP_UNITS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids (array of int).

    decoded_sha256 is of the bytes that decoding the ids gives. ``vocabulary``
    is a rank file at the same path on every executor. ``block_bytes`` and
    ``keep_units`` trade memory for time and change no result.
    """
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(kinds + [("ids", pa.list_(pa.int32()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ("bpe", vocabulary, pattern, keep_units)
        for batch in common.slices(batches, 1, block_bytes, key):
            c = common.resident(key, lambda: Coder(vocabulary, pattern, keep_units))
            rows = []
            arrays = []
            for ids in c.encode([t or "" for t in batch.column(1).to_pylist()]):
                digest = hashlib.sha256(",".join(map(c.v.text.__getitem__, ids)).encode()).hexdigest()
                rows.append((len(ids), digest, hashlib.sha256(c.v.decode(ids)).hexdigest()))
                if with_ids:
                    arrays.append(np.array(ids, np.int32))
            columns = [batch.column(0), *(pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), kinds[1:], strict=True))]
            if with_ids:
                at = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(arrays))))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    sql = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return common.key_text(docs, id_col, text_col).mapInArrow(run, sql)


def decode_ids(tokens: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the decoded bytes of each row's ids; null ids give no bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = ranks_at(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.decode(x or ()) for x in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "bytes"])

    return tokens.select(tokens[id_col].cast("long").alias("doc_id"), tokens[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, bytes binary")
