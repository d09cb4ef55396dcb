"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import kept as written
from ..plans.storage import settled, shared_dir

__all__ = ["settled", "shared_dir", "written"]

T = TypeVar("T")

#: Text bytes that a Python operator turns into numpy arrays at once.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def content_key(text: Column) -> Column:
    """A 64-bit hash that, with the id, tells a row of documents from others with the same id. Rows equal in both are copies of one row."""
    return F.xxhash64(text.cast("string"))


def key_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under names of its own."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def n_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def range_bounds(ids: DataFrame, col: str, n: int) -> list[int]:
    """At most n-1 ascending cut points that split the ids into like parts.

    Approximate quantiles of one column: a small state for each task. The
    cuts decide only where rows are dealt, never a result.
    """
    if n < 2:
        return []
    found = ids.agg(F.percentile_approx(col, [i / n for i in range(1, n)], 10_000).alias("q")).first()
    return sorted({int(x) for x in (found["q"] or []) if x is not None})


def bucket_of(col: Column, bounds: list[int]) -> Column:
    """How many cuts lie below a value, by binary descent over literals; null: 0."""

    def pick(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(col > F.lit(bounds[mid]), pick(mid + 1, hi)).otherwise(pick(lo, mid))

    return F.when(col.isNull(), F.lit(0)).otherwise(pick(0, len(bounds)))


#: Rows of keys that may be sent to every task; a larger table is joined by a shuffle.
BROADCAST_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if it has been counted to at most BROADCAST_ROWS rows.

    ``df`` should be a written table, as it is read twice.
    """
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def without(docs: DataFrame, rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: str = "left_anti") -> DataFrame:
    """The rows of ``docs`` whose id (null is an id too) and text aren't among ``rows`` (__id, __text_key)."""
    same = docs[id_col].cast("long").eqNullSafe(rows["__id"]) & (content_key(docs[text_col]) == rows["__text_key"])
    return docs.join(small(rows), same, how)


def once(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of those that are equal in id and text; only such rows pass through a shuffle."""
    keys = docs.select(docs[id_col].cast("long").alias("__id"), content_key(docs[text_col]).alias("__text_key"))
    twice = written(keys.groupBy("__id", "__text_key").count().filter("count > 1").drop("count"), "repeated-rows")
    repeated = without(docs, twice, id_col, text_col, "left_semi").dropDuplicates([id_col, text_col])
    return without(docs, twice, id_col, text_col).union(repeated)


_resident: dict[tuple, object] = {}


def resident(key: tuple, make: Callable[[], T]) -> T:
    """An object that a worker process keeps from task to task, such as a cache of coded words.

    Workers outlive a stage, so one object is kept at a time: ``slices``,
    which every operator calls first, lets go of another operator's.
    """
    if key not in _resident:
        _release()
        _resident[key] = make()
    return _resident[key]


def _release(keep: tuple | None = None) -> None:
    gone = [k for k in _resident if k != keep]
    for k in gone:
        del _resident[k]
    if gone:
        _trim()


def _trim() -> None:
    """Gives what this process has freed back to the system; idle workers stay for a while, and others need the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text_at: int, limit: int = SLICE_BYTES, keep: tuple | None = None) -> Iterator[pa.RecordBatch]:
    """Each batch cut into runs of rows with at most ``limit`` text bytes (one row at least).

    ``keep``: the key of the resident object that the caller goes on using.
    """
    _release(keep)
    try:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sizes = np.zeros(n + 1, np.int64)
            sizes[1:] = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_at)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < n:
                upto = max(at + 1, int(np.searchsorted(sizes, sizes[at] + limit, side="right")) - 1)
                yield batch.slice(at, upto - at)
                at = upto
    finally:
        _trim()
