"""Building the partitioned index: sample, k-means, lists, blocks.

References are ref_id, label and the quantized slots s0..s13; ``decoded``
gives them as single-precision slots. A list is the references nearest to a
centroid; its members, ordered by distance to it (radius), are cut in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar
from ..functions.scalar import SLOTS
from ..plans.storage import kept

# Defaults for a reference set of millions; small sets need fewer lists.
NLIST, NPROBE, BLOCK, SAMPLE, ITERATIONS = 2048, 4, 64, 131_072, 16
#: List ids are 16 bits wide, so the centroids are always small enough for broadcast.
MAX_NLIST = 65_536


def decoded(refs: DataFrame, *keep: str) -> DataFrame:
    return refs.select("ref_id", *keep, *scalar.unpack())


def sample_exact(refs: DataFrame, n: int = SAMPLE, seed: int = 1) -> DataFrame:
    """Exactly n rows (all, if fewer), the same for the same ids: those whose ids' md5 come first.

    ``n`` bounds what is sorted together: each task keeps n rows at most.
    """
    return refs.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col("ref_id").cast("string"))), "ref_id").limit(n)


def spaced_centroids(points: DataFrame, k: int) -> DataFrame:
    """list_id and c0..: every (n/k)-th point in order of ref_id.

    Ranks come from a sort by range and per-partition counts, not from a
    window over all rows.
    """
    spark = points.sparkSession
    ids = points.select("ref_id").distinct().sort("ref_id")
    ranked = kept(ids.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id() % (1 << 33)), "ranks")
    counts = {r["part"]: r["count"] for r in ranked.groupBy("part").count().collect()}  # one row a partition
    n, base, before = sum(counts.values()), [], 0
    for part in sorted(counts):
        base.append((part, before))
        before += counts[part]
    if n < k:
        raise ValueError(f"{n} points can't make {k} centroids")
    wanted = spark.createDataFrame([(i, i * n // k) for i in range(k)], "list_id int, rank long")
    bases = spark.createDataFrame(base, "part int, before long")
    chosen = ranked.join(F.broadcast(bases), "part").select("ref_id", (F.col("before") + F.col("place")).alias("rank")).join(F.broadcast(wanted), "rank")
    return points.join(F.broadcast(chosen.select("ref_id", "list_id")), "ref_id").select("list_id", *[F.col(s).alias(f"c{i}") for i, s in enumerate(SLOTS)])


def assign(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """``points`` with list_id and radius: the nearest centroid, the lowest id among equals.

    At most MAX_NLIST centroids go to every task; a numpy pass keeps a row a
    row, so nothing is multiplied, shuffled or grouped.
    """
    rows = centroids.select("list_id", *[f"c{i}" for i in range(len(SLOTS))]).orderBy("list_id").limit(MAX_NLIST + 1).collect()
    if not rows or len(rows) > MAX_NLIST:
        raise ValueError(f"between 1 and {MAX_NLIST} centroids, please")
    sent = points.sparkSession.sparkContext.broadcast((np.array([r[0] for r in rows], np.int32), np.array([list(r)[1:] for r in rows], np.float32)))
    kept_columns = [c for c in points.columns if c not in ("list_id", "radius")]
    at = [kept_columns.index(s) for s in SLOTS]
    step = max(1, (1 << 22) // len(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, centres = sent.value
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                d = np.zeros((batch.num_rows, len(ids)), np.float32)
                for i, k in enumerate(at):
                    gap = batch.column(k).to_numpy()[:, None] - centres[None, :, i]
                    gap *= gap
                    d += gap
                best = d.argmin(1)  # the first of equals
                radius = np.sqrt(d[np.arange(len(best)), best].astype(np.float64)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ids[best]), pa.array(radius)], names=[*kept_columns, "list_id", "radius"])

    points = points.select(*kept_columns)
    schema = T.StructType([*points.schema.fields, T.StructField("list_id", T.IntegerType()), T.StructField("radius", T.FloatType())])
    return points.mapInArrow(run, schema)


def lloyd_step(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """The centroids' means after assignment; an empty list keeps its centroid (it is reseeded by ``kmeans``)."""
    means = assign(points, centroids).groupBy("list_id").agg(*[F.avg(s).cast("float").alias(f"m{i}") for i, s in enumerate(SLOTS)], F.count("*").alias("n"))
    joined = centroids.join(F.broadcast(means), "list_id", "left")
    return joined.select("list_id", *[F.coalesce(f"m{i}", f"c{i}").alias(f"c{i}") for i in range(len(SLOTS))], F.coalesce("n", F.lit(0)).alias("n"))


def kmeans(points: DataFrame, k: int = NLIST, iterations: int = ITERATIONS, seed: int = 1) -> DataFrame:
    """Centroids after Lloyd's iterations; a list that runs empty restarts at a point picked by hash.

    The driver holds the centroids, at most MAX_NLIST rows, from one iteration to the next.
    """
    if k > MAX_NLIST:
        raise ValueError(f"at most {MAX_NLIST} lists")
    spark, slots = points.sparkSession, [f"c{i}" for i in range(len(SLOTS))]
    schema = "list_id int, " + ", ".join(f"{c} float" for c in slots)
    rows = [tuple(r) for r in spaced_centroids(points, k).select("list_id", *slots).collect()]
    for step in range(iterations):
        new = lloyd_step(points, spark.createDataFrame(rows, schema)).select("list_id", *slots, "n").collect()
        rows, empty = [tuple(r)[:-1] for r in new if r["n"]], [r for r in new if not r["n"]]
        if empty:
            spare = points.orderBy(scalar.pseudo_random(F.col("ref_id"), seed + step), "ref_id").limit(len(empty)).select(*SLOTS).collect()
            rows += [(r["list_id"], *x) for r, x in zip(empty, spare, strict=True)]
    return spark.createDataFrame(rows, schema)


def layout(assigned: DataFrame, block: int = BLOCK) -> DataFrame:
    """``assigned`` with place (0.. in its list, by radius) and block_id.

    Rows are sorted by ranges and counted for each list and range, so a list
    of any size is laid out by many tasks. ``assigned`` is read twice.
    """
    order = ["list_id", "radius", "ref_id"]
    sorted_rows = kept(assigned.sort(*order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id() % (1 << 33)}), "ordered")
    runs = sorted_rows.groupBy("list_id", "__part").agg(F.min("__at").alias("__begin"), F.count("*").alias("__n"))
    before = Window.partitionBy("list_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("list_id", "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__begin")).alias("__shift"))
    # ranges follow one another, so there are at most as many runs as lists and partitions
    placed = sorted_rows.join(F.broadcast(runs), ["list_id", "__part"]).withColumn("place", (F.col("__at") + F.col("__shift")).cast("int"))
    return placed.select(*assigned.columns, "place", F.floor(F.col("place") / block).cast("int").alias("block_id"))


def list_stats(assigned: DataFrame, block: int = BLOCK) -> DataFrame:
    """list_id, n, radius (largest), blocks."""
    return assigned.groupBy("list_id").agg(F.count("*").alias("n"), F.max("radius").alias("radius")).withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))


def list_offsets(stats: DataFrame) -> DataFrame:
    """Exclusive running sums of sizes and block counts; the table has one row a list."""
    before = Window.orderBy("list_id").rowsBetween(Window.unboundedPreceding, -1)
    return stats.select("list_id", "n", "blocks", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("first_block"))


def block_stats(laid_out: DataFrame) -> DataFrame:
    return laid_out.groupBy("list_id", "block_id").agg(F.min("radius").alias("min_radius"), F.max("radius").alias("max_radius"), F.count("*").alias("n"))


def totals(stats: DataFrame) -> DataFrame:
    return stats.agg(F.max("n").alias("largest_list"), F.sum("n").alias("vectors"), F.count("*").alias("lists"))


def meta(spark: SparkSession, nlist: int, block: int, vectors: int) -> DataFrame:
    return spark.createDataFrame([(FORMAT, scalar.DIM, nlist, block, vectors)], "format int, dim int, nlist int, block int, vectors long")


FORMAT = 1
