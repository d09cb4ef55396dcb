"""SimHash near-duplicates by tiled exact comparison.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 hashes of
its 4-word shingles. Distinct fingerprints (copies collapse before anything is
compared) are put into tiles by population count, and every pair of tiles is
compared whole with numpy exclusive-or and bit counts, except pairs whose
population counts differ by more than the radius: no link can lie there.
Inside a pair the same bound is applied to the counts of the four 16-bit
quarters of smaller tiles. So no link within the radius is missed.

A popular popcount is dealt into as many tiles as its size asks for, so a task
holds two tiles of bounded size. A task returns a spanning forest of its
links, never all pairs of a group; components come from the forests.

Cost: the comparisons are exact and so quadratic in distinct fingerprints (about half of
all pairs pass the bound on counts); the README has the figures.

Defined results: null and empty texts have fingerprint 0 and link like any
other. Repeated rows come back one each. A null id is kept; component_id is
the smallest non-null id, or null if there is none. ``deduplicate`` decides by row, that is by id and text: rows that share
an id (a null one too) and differ in text are different documents. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import Forest, components

WORDS, SEED, BITS, RADIUS = 4, 42, 64, 4
#: Most fingerprints of a tile, and of a tile inside it.
TILE, SMALL = 1 << 18, 256
#: Least tiles of a large table, for the sake of all cores.
LEAST_TILES = 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def fingerprint(text: str | None) -> int:
    """bytes.split() cuts at x20 and x09 to x0D, no other byte."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *(e + 1 for e in ends[:-1])]
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(line[a:b], SEED) for a, b in zip(starts, ends[WORDS - 1 :], strict=False)]) or digest(line, SEED)
    n, counts, step = len(hashes) // 8, np.zeros(BITS, np.int64), 1 << 15
    bits = np.frombuffer(hashes, np.uint8)
    for at in range(0, n, step):  # big-endian, so bit 63 comes first
        counts += np.unpackbits(bits[at * 8 : (at + step) * 8]).reshape(-1, BITS).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (see ``common.content_key``) and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            prints = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(prints)], names=["doc_id", "text_key", "fp"])

    rows = common.key_text(docs, id_col, text_col).withColumn("text_key", common.content_key(F.col("text")))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _small_tiles(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by quarters' bit counts, and the least and largest of these in each small tile."""
    quarters = np.bitwise_count(fp.view(np.uint16).reshape(-1, 4)).astype(np.int16)
    order = np.lexsort(quarters.T)
    cuts = np.arange(0, len(fp), SMALL)
    return order, np.minimum.reduceat(quarters[order], cuts), np.maximum.reduceat(quarters[order], cuts)


def forest_of(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Tree links (larger, smaller) of all pairs within ``a``, or between ``a`` and ``b``, at most ``radius`` bits apart."""
    fp = a if b is None else np.concatenate([a, b])
    fp_sorted = np.argsort(fp.view(np.int64), kind="stable")
    fp = fp[fp_sorted]  # so that the least node of a tree is its least fingerprint
    back = np.empty(len(fp), np.int64)
    back[fp_sorted] = np.arange(len(fp))
    forest = Forest(len(fp))
    ia = back[: len(a)]
    ib = ia if b is None else back[len(a) :]
    oa, la, ha = _small_tiles(fp[ia])
    ob, lb, hb = (oa, la, ha) if b is None else _small_tiles(fp[ib])
    ia, ib = ia[oa], ib[ob]
    fa, fb = fp[ia], fp[ib]
    for i in range(len(la)):
        gap = np.maximum(0, np.maximum(lb - ha[i], la[i] - hb)).sum(1)
        for j in np.flatnonzero(gap <= radius).tolist():
            if b is None and j < i:
                continue
            x, y = fa[i * SMALL : (i + 1) * SMALL], fb[j * SMALL : (j + 1) * SMALL]
            near = np.bitwise_count(x[:, None] ^ y[None, :]) <= radius
            if b is None and i == j:
                np.fill_diagonal(near, False)
            if near.any():
                p, q = np.nonzero(near)
                forest.link(ia[i * SMALL + p], ib[j * SMALL + q])
    tied = np.flatnonzero(forest.root != np.arange(len(fp)))
    return fp[tied].view(np.int64), fp[forest.root[tied]].view(np.int64)


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """u > v: a forest with the components of all fingerprints ``fp`` within ``radius`` bits.

    ``distinct`` holds each fingerprint once and is read twice.
    """
    tile_of = F.bit_count("fp")
    found = {r["pop"]: r["n"] for r in distinct.groupBy(tile_of.alias("pop")).agg(F.count("*").alias("n")).collect()}  # 65 rows at most
    most = max(1024, min(tile, sum(found.values()) // LEAST_TILES))
    groups: list[list[int]] = []  # least and largest popcount, fingerprints
    for pop in sorted(found):
        if groups and groups[-1][2] + found[pop] <= most:
            groups[-1][1], groups[-1][2] = pop, groups[-1][2] + found[pop]
        else:
            groups.append([pop, pop, found[pop]])
    if not groups:
        return distinct.select(F.col("fp").alias("u"), F.col("fp").alias("v")).limit(0)
    tiles = [-(-n // most) for _, _, n in groups]
    offset = [0, *accumulate(tiles)]
    near = [[k for k, o in enumerate(groups) if o[0] - g[1] <= radius and g[0] - o[1] <= radius] for g in groups]

    def by_group(values: list[int]):
        out = F.lit(values[-1])
        for g, value in list(zip(groups, values, strict=True))[-2::-1]:
            out = F.when(tile_of <= g[1], value).otherwise(out)
        return out

    dealt = distinct.select(
        "fp",
        (by_group(offset[:-1]) + F.pmod(F.xxhash64("fp"), by_group(tiles).cast("long")).cast("int")).alias("own"),
        by_group([offset[k[0]] for k in near]).alias("first"),
        by_group([offset[k[-1] + 1] - 1 for k in near]).alias("last"),
    ).select("fp", "own", F.explode(F.sequence("first", "last")).alias("other"))

    def compare(t: pa.Table) -> pa.Table:
        fp, own, other = (t.column(c).to_numpy() for c in ("fp", "own", "other"))
        fp = fp.view(np.uint64)
        low = own <= other
        same = bool((own == other).all())
        u, v = forest_of(fp, None, radius) if same else forest_of(fp[low], fp[~low], radius) if low.any() and not low.all() else (np.zeros(0, np.int64),) * 2
        return pa.table({"u": pa.array(u), "v": pa.array(v)})

    pairs = dealt.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
    # a stated number of partitions isn't coalesced: a pair is few bytes and much work
    pairs = pairs.repartition(common.n_partitions(distinct.sparkSession), "a", "b").groupBy("a", "b")
    return pairs.applyInArrow(compare, "u long, v long")


#: Rows of a fingerprint from which they are joined by broadcast, or a larger share of all rows; so there are at most SHARES such fingerprints.
HOT_ROWS, SHARES = 10_000, 10_000


def _grouped(docs: DataFrame, radius: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key, fp, component_id (smallest id) and first_key: the least text_key among the rows with that id, or with none where all are null."""
    prints = common.written(fingerprints(docs, id_col, text_col), "simhash")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")  # the first row of a group has the smallest id
    distinct = common.written(prints.groupBy("fp").agg(F.min(row).alias("first"), F.count("*").alias("n")), "simhash-distinct")
    tied = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(tied.withColumnRenamed("u", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("v", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("first").alias("group_first"))
    of_print = rooted.join(first, "root").select("fp", "n", F.col("group_first.doc_id").alias("component_id"), F.col("group_first.text_key").alias("first_key"))
    of_print = common.written(of_print, "simhash-components")
    hot = F.col("n") > max(HOT_ROWS, prints.count() // SHARES)
    # fingerprints with very many rows go to every task; the rest are joined by a shuffle
    marked = prints.join(F.broadcast(of_print.filter(hot).drop("n").withColumn("hot", F.lit(True))), "fp", "left")
    some = marked.filter("hot").drop("hot")
    return some.unionByName(marked.filter("hot is null").select("fp", "doc_id", "text_key").join(of_print.filter(~hot).drop("n"), "fp"))


def near_duplicates(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest id reachable by links)."""
    return _grouped(docs, radius, id_col, text_col).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, all columns: that with the smallest id, and of rows with this id the one with the least hash of its text.

    Rows without an id come after all others. Rows equal in id and text count
    as one document, and one of them stays.
    """
    spark, key = docs.sparkSession, [F.col("doc_id").alias("__id"), F.col("text_key").alias("__text_key")]
    found = common.settled(spark, lambda: _grouped(docs, radius, id_col, text_col).select("doc_id", "text_key", "component_id", "first_key"), "simhash-groups")
    lost = ~(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("text_key") == F.col("first_key")))
    losers = common.written(found.filter(lost).select(*key).distinct(), "simhash-losers")
    twice = common.written(found.filter(~lost).groupBy(*key).count().filter("count > 1").drop("count"), "simhash-repeated")
    kept = common.without(docs, losers, id_col, text_col)
    repeated = common.without(kept, twice, id_col, text_col, "left_semi").dropDuplicates([id_col, text_col])
    return common.without(kept, twice, id_col, text_col).union(repeated)
