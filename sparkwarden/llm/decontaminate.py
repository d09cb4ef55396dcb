"""Benchmark decontamination over a distributed positional inverted index.

The index is split by documents: each row of its table is a segment (about
SLICE_BYTES of text) with, for each stored term, the ascending positions where
the segment has it. A search looks at a segment alone, so nothing is shuffled,
no common term's list meets in one place, and segments can be searched again
and again. A phrase is found by taking the positions of its rarest term in the
segment and intersecting, term by rarer term, with the lists of the others
moved by their offset in the phrase. Documents of a segment are parted by a
position that holds no term, so no phrase runs from one to the next.

Terms are 64-bit hashes of whole words. The index may keep all terms, or those
of a given table alone: other terms' lists are never read by its phrases. The test set's terms are
such a table if they are at most MAX_TERMS (8 bytes each go to every task); otherwise all terms are kept, with the same result.

Test phrases go to the tasks in blocks of at most BLOCK_BYTES of text. A
larger test set takes as many searches as it has blocks, one after the other: the driver
holds one block at a time, a block's hits are a table before the next is read, and all hits are
united document by document.

Defined results: a null or empty text has no words, n_hit 0 and is clean. Item
texts that are null, or have no word, never occur. Item ids are strings here;
a null item id counts as "". Rows come back one for each document row, repeated
rows included. ``clean`` decides by id and text, so that rows that share an id and differ in text don't share their fate.
Other columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

WINDOW = 13
#: A document is contaminated if SHARE * n_hit >= n_words, and n_hit > 0.
SHARE = 20
#: Bytes of test text that one search carries to every task.
BLOCK_BYTES = 4 << 20
#: Terms of the test set that go to every task.
MAX_TERMS = 1 << 20

SEGMENT = pa.schema(
    [
        ("segment", pa.string()),
        ("doc_ids", pa.list_(pa.int64())),
        ("text_keys", pa.list_(pa.int64())),
        ("first", pa.list_(pa.int64())),  # words before each document, and of all
        ("terms", pa.list_(pa.int64())),  # ascending as unsigned
        ("counts", pa.list_(pa.int32())),
        ("postings", pa.binary()),  # uint32 positions, by term
    ]
)
SEGMENT_SQL = "segment string, doc_ids array<long>, text_keys array<long>, first array<long>, terms array<long>, counts array<int>, postings binary"


def vocabulary(items: DataFrame, text_col: str = "text", limit: int = MAX_TERMS) -> np.ndarray | None:
    """Sorted hashes of all terms of the test set, or None if they are more than ``limit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(wordhash.words(batch.column(0), wordhash.ALNUM).hashes()).view(np.int64))], names=["term"])

    found = items.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "term long").distinct().limit(limit + 1).toArrow()
    return np.sort(found.column("term").to_numpy().view(np.uint64)) if found.num_rows <= limit else None


def _member(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    at = np.searchsorted(sorted_values, x)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == x


def build_index(docs: DataFrame, terms: np.ndarray | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of segments. ``terms``: sorted hashes of the only terms to store (None: all)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            w = wordhash.words(batch.column(1), wordhash.ALNUM)
            h = w.hashes()
            # one empty position after each document
            at = np.arange(len(h), dtype=np.int64) + np.repeat(np.arange(batch.num_rows), np.diff(w.first))
            if terms is not None:
                keep = _member(terms, h)
                h, at = h[keep], at[keep]
            order = np.argsort(h, kind="stable")
            h = h[order]
            cuts = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
            row = {
                "segment": uuid.uuid4().hex,
                "doc_ids": batch.column(0).to_pylist(),
                "text_keys": batch.column(2).to_pylist(),
                "first": w.first.tolist(),
                "terms": h[cuts].view(np.int64).tolist(),
                "counts": np.diff(np.append(cuts, len(h))).tolist(),
                "postings": at[order].astype("<u4").tobytes(),
            }
            yield pa.RecordBatch.from_pylist([row], schema=SEGMENT)

    rows = common.key_text(docs, id_col, text_col).withColumn("text_key", common.content_key(F.col("text")))
    return rows.mapInArrow(run, SEGMENT_SQL)


class Segment:
    def __init__(self, row: dict):
        self.doc_ids, self.text_keys = row["doc_ids"], row["text_keys"]
        self.first = np.array(row["first"], np.int64)
        self.words = np.diff(self.first)
        self.begin = self.first[:-1] + np.arange(len(self.doc_ids))  # position of each document's first word
        self.terms = np.array(row["terms"], np.int64).view(np.uint64)
        self.cut = np.concatenate([[0], np.cumsum(np.array(row["counts"], np.int64))]).astype(np.int64)
        self.postings = np.frombuffer(row["postings"], "<u4").astype(np.int64)
        self.length = int(self.first[-1]) + len(self.doc_ids)

    def counts(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of term hashes: where they are in the segment's table, and how often they occur."""
        if not len(self.terms):
            return np.zeros(h.shape, np.int64), np.zeros(h.shape, np.int64)
        at = np.searchsorted(self.terms, h)
        at[at == len(self.terms)] = 0
        return at, np.where(self.terms[at] == h, self.cut[at + 1] - self.cut[at], 0)

    def list_of(self, k: int) -> np.ndarray:
        return self.postings[self.cut[k] : self.cut[k + 1]]

    def doc_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, positions, side="right") - 1

    def phrase(self, at: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Positions where the terms (rows ``at`` of the table, ``n`` postings each) follow each other."""
        order = np.argsort(n, kind="stable")
        found = self.list_of(at[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            found = found[_member(self.list_of(at[k]), found + k)]
        return found

    def near(self, at: np.ndarray, n: np.ndarray, within: int) -> np.ndarray:
        """Positions of the rarest term with every other term at most ``within`` words away in its document."""
        order = np.argsort(n, kind="stable")
        found = self.list_of(at[order[0]])
        low, doc = np.maximum(found - within, self.begin[self.doc_of(found)]), self.doc_of(found)
        high = np.minimum(found + within, self.begin[doc] + self.words[doc] - 1)
        ok = np.ones(len(found), bool)
        for k in order[1:]:
            p = self.list_of(at[k])
            ok &= np.searchsorted(p, high, side="right") > np.searchsorted(p, low, side="left")
        return found[ok]


def _windows(texts: list[str], size: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(windows x length hashes, item number of each), by window length."""
    w = wordhash.words(pa.array(texts, pa.string()), wordhash.ALNUM)
    h, whole, item, short = w.hashes(), [], [], {}
    for i in range(len(texts)):
        own = h[w.first[i] : w.first[i + 1]]
        if len(own) >= size:
            v = np.lib.stride_tricks.sliding_window_view(own, size)
            whole.append(v)
            item += [i] * len(v)
        elif len(own):
            short.setdefault(len(own), []).append((own, i))
    out = [(np.concatenate(whole), np.array(item))] if whole else []
    return out + [(np.array([x for x, _ in v]), np.array([i for _, i in v])) for _, v in sorted(short.items())]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    """The test set in blocks of BLOCK_BYTES; only one is held at a time."""
    block, held = [], 0
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    for r in rows.toLocalIterator():
        if block and held + len(r["t"]) > BLOCK_BYTES:
            yield block
            block, held = [], 0
        block.append((r["i"], r["t"]))
        held += len(r["t"])
    yield block


FOUND = pa.schema([("segment", pa.string()), ("nth", pa.int32()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("items", pa.list_(pa.string()))])
FOUND_SQL = "segment string, nth int, doc_id long, text_key long, n_words long, starts array<long>, ends array<long>, items array<string>"


def _spans(edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs where the running sum of ``edge`` is over 0."""
    change = np.diff(np.concatenate([[False], np.cumsum(edge) > 0, [False]]).astype(np.int8))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def phrase_matches(index: DataFrame, block: list[tuple[str, str]], window: int = WINDOW, all_docs: bool = True) -> DataFrame:
    """For every document, or every one that is hit: the spans of words [start, end) that a block's phrases hit, and the items they are from."""
    ids = [i for i, _ in block]
    by_length = _windows([t for _, t in block], window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row)
                edge = np.zeros(s.length + 1, np.int32)
                met: list[set[str]] = [set() for _ in s.doc_ids]
                for phrases, item in by_length:
                    at, n = s.counts(phrases)
                    for k in np.flatnonzero(n.min(1) > 0).tolist():
                        found = s.phrase(at[k], n[k])
                        if len(found):
                            np.add.at(edge, found, 1)
                            np.add.at(edge, found + phrases.shape[1], -1)
                            for d in np.unique(s.doc_of(found)).tolist():
                                met[d].add(ids[item[k]])
                starts, ends = _spans(edge)
                doc = s.doc_of(starts)
                cut = np.searchsorted(doc, np.arange(len(s.doc_ids) + 1)).tolist()
                out = [
                    {
                        "segment": row["segment"],
                        "nth": d,
                        "doc_id": i,
                        "text_key": s.text_keys[d],
                        "n_words": int(s.words[d]),
                        "starts": (starts[cut[d] : cut[d + 1]] - s.begin[d]).tolist(),
                        "ends": (ends[cut[d] : cut[d + 1]] - s.begin[d]).tolist(),
                        "items": list(met[d]),
                    }
                    for d, i in enumerate(s.doc_ids)
                    if all_docs or met[d]
                ]
                yield pa.RecordBatch.from_pylist(out, schema=FOUND)

    return index.mapInArrow(run, FOUND_SQL)


def proximity_matches(index: DataFrame, queries: list[tuple[str, str]], within: int) -> DataFrame:
    """doc_id, query, position: words with all of a query's words at most ``within`` words away.

    ``position`` (in words of the document) is of the query's rarest word in
    the segment. ``queries`` are pairs of id and text, a list given by the caller.
    """
    w = wordhash.words(pa.array([t for _, t in queries], pa.string()), wordhash.ALNUM)
    h = w.hashes()
    terms = [np.unique(h[w.first[i] : w.first[i + 1]]) for i in range(len(queries))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                s = Segment(row)
                for (name, _), own in zip(queries, terms, strict=True):
                    at, n = s.counts(own)
                    if len(n) and n.min() > 0:
                        found = s.near(at, n, within)
                        doc = s.doc_of(found)
                        yield pa.RecordBatch.from_arrays([pa.array([s.doc_ids[d] for d in doc.tolist()], pa.int64()), pa.array([name] * len(found), pa.string()), pa.array(found - s.begin[doc])], names=["doc_id", "query", "position"])

    return index.mapInArrow(run, "doc_id long, query string, position long")


def _united(found: DataFrame) -> DataFrame:
    """One row a document from the rows that several searches gave it."""
    rows = found.groupBy("segment", "nth").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("text_key").alias("text_key"),
        F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("starts")).alias("starts"),
        F.flatten(F.collect_list("ends")).alias("ends"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = batch.to_pylist()
            for r in out:
                edge = np.zeros(r["n_words"] + 1, np.int32)
                np.add.at(edge, np.array(r["starts"], np.int64), 1)
                np.add.at(edge, np.array(r["ends"], np.int64), -1)
                r["starts"], r["ends"] = (x.tolist() for x in _spans(edge))
            yield pa.RecordBatch.from_pylist(out, schema=FOUND)

    return rows.mapInArrow(run, FOUND_SQL)


def _searched(docs: DataFrame, items: DataFrame, window: int, id_col: str, text_col: str, item_id_col: str, item_text_col: str) -> DataFrame:
    index = common.written(build_index(docs, vocabulary(items, item_text_col), id_col, text_col), "positional-index")
    blocks = _blocks(items, item_id_col, item_text_col)
    block, following = next(blocks), next(blocks, None)
    found = phrase_matches(index, block, window)
    if following is None:
        return found
    found = common.written(found, "phrase-hits")
    while following is not None:
        found = found.unionByName(common.written(phrase_matches(index, following, window, all_docs=False), "phrase-hits"))
        following = next(blocks, None)
    return _united(found)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items, starts, ends (spans of words that are hit), contaminated and text_key (tells rows of one id)."""
    found = _searched(docs, items, window, id_col, text_col, item_id_col, item_text_col)
    n_hit = F.aggregate(F.zip_with("ends", "starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, b: a + b)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sort_array("items").alias("items"),
        "starts",
        "ends",
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"),
        "text_key",
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, without those that are contaminated."""

    def bad() -> DataFrame:
        found = contamination(docs, items, window, id_col, text_col).filter("contaminated")
        return found.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__text_key")).distinct()

    return common.without(docs, common.settled(docs.sparkSession, bad, "contaminated"), id_col, text_col)
