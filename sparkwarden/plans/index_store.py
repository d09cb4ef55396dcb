"""Building, writing and opening an index."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import index as ops
from .storage import delete, settled, shared_dir


@dataclass
class Index:
    centroids: DataFrame  # list_id, c0..c13
    lists: DataFrame  # list_id, n, radius, blocks
    blocks: DataFrame  # list_id, block_id, min_radius, max_radius, n
    vectors: DataFrame  # ref_id, label, s0..s13 (quantized), list_id, block_id, place, radius
    meta: DataFrame

    path: str | None = None  # of an index that ``build`` has made; an opened one belongs to whoever wrote it

    def close(self) -> None:
        """Deletes the tables of an index that ``build`` has made."""
        if self.path:
            delete(self.meta.sparkSession, self.path)


def build(refs: DataFrame, nlist: int = ops.NLIST, block: int = ops.BLOCK, sample: int = ops.SAMPLE, iterations: int = ops.ITERATIONS, centroids: DataFrame | None = None) -> Index:
    """The index of ``refs``, in a folder of its own under the shared one until it is closed; ``centroids``, if given, are taken as they are."""
    if nlist > ops.MAX_NLIST:
        raise ValueError(f"at most {ops.MAX_NLIST} lists")
    spark = refs.sparkSession
    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"

    def laid_out() -> DataFrame:
        points = ops.decoded(refs)
        made = centroids if centroids is not None else ops.kmeans(ops.kept(ops.sample_exact(points, sample), "sample"), nlist, iterations)
        made.coalesce(1).write.parquet(f"{path}/centroids")
        # only ids and places pass through the shuffle of the layout, which reads them twice
        assigned = ops.kept(ops.assign(points, spark.read.parquet(f"{path}/centroids")).select("ref_id", "list_id", "radius"), "assigned")
        return ops.layout(assigned, block)

    places = settled(spark, laid_out, "layout")  # what training has kept goes with it
    _dealt(refs.join(places, "ref_id")).write.parquet(f"{path}/vectors")
    ops.list_stats(places, block).coalesce(1).write.parquet(f"{path}/lists")
    ops.block_stats(places).coalesce(1).write.parquet(f"{path}/blocks")
    ops.meta(spark, nlist, block, refs.count()).coalesce(1).write.parquet(f"{path}/meta")
    return replace(open_index(spark, path), path=path)


def _dealt(vectors: DataFrame, partitions: int | None = None) -> DataFrame:
    """Ranges of (list_id, radius): lists lie together, and a list of any size is cut."""
    keys = ("list_id", "radius", "ref_id")
    dealt = vectors.repartitionByRange(partitions, *keys) if partitions else vectors.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys)


def write(index: Index, path: str, partitions: int | None = None) -> None:
    """Five Parquet tables; vectors lie in ranges of list and radius."""
    for name in ("centroids", "lists", "blocks", "meta"):
        getattr(index, name).coalesce(1).write.parquet(f"{path}/{name}")
    _dealt(index.vectors, partitions).write.parquet(f"{path}/vectors")


def open_index(spark: SparkSession, path: str) -> Index:
    """Refuses an index of another format or dimension."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    row = read("meta").first()
    if row["format"] != ops.FORMAT or row["dim"] != scalar.DIM:
        raise ValueError(f"index at {path}: format {row['format']}, dimension {row['dim']}; expected {ops.FORMAT}, {scalar.DIM}")
    return Index(read("centroids"), read("lists"), read("blocks"), read("vectors"), read("meta"))


def ready(spark: SparkSession, path: str) -> bool:
    """Whether an index can be opened there and isn't empty."""
    try:
        return open_index(spark, path).meta.filter(F.col("vectors") > 0).count() == 1
    except Exception:  # whatever a file system says about a missing or broken folder
        return False
