"""Contiguous shards of nearly equal bytes, by global prefix sums.

Documents are put in order: by the smallest id among those with the same text, then by a hash of the text, then by their own id, so that
equal texts stand together and the order of ids holds otherwise. Totals of bytes for each range partition of
that order go to the driver (one row a partition), their running sums become each
partition's start, and a running sum inside the partition completes the prefix sum of
every row. The sums are cut at equal targets.

Law: ``bytes``. A group of equal texts stays in one shard if it has at most 1/WHOLE of a shard's target: the shard in whose
target the group's middle byte lies. A larger group (it may hold a third of all rows) is cut like any run of
rows, each row by its own middle byte, as this law promises balance: a shard differs from the target
by less than the two groups, or rows, at its ends. A text of its own is a group of one row.

Texts count as equal if their 64-bit hashes, sizes and crc32 are. Defined results: a null text has no bytes (size 8, crc32 0) and is grouped with
the empty text. A null id sorts before all others. Rows equal in text and id are interchangeable. An empty table gives an empty result.
Other columns, whatever their names, are not read; ``write_shards`` passes them on, and tells rows by id and text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

OVERHEAD = 8
#: Groups of equal texts of up to this part of a shard's bytes are kept whole.
WHOLE = 20
_NULL_ID = -(1 << 63)
#: Groups that are joined by broadcast have over one part in so many of all bytes each, so there are fewer than these.
HOT_SHARES = 10_000
_GROUP = ["text_key", "size", "text_crc32"]
_NUMBERED_SQL = "doc_id long, text_key long, size long, text_crc32 long, first_id long, group_bytes long, part int, nth long, upto long, in_group long"


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows of a partition in order, with the bytes up to and with each, and those of its group up to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, total, held, before, nth = TaskContext.get().partitionId(), 0, None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            size = batch.column(2).to_numpy()
            group = np.stack([batch.column(k).to_numpy() for k in (1, 2, 3)])
            upto = total + np.cumsum(size)
            new = np.ones(len(size), bool)
            new[1:] = (group[:, 1:] != group[:, :-1]).any(0)
            goes_on = held is not None and (group[:, 0] == held).all()
            begin = np.where(new, upto - size, 0)
            if goes_on:
                begin[0] = before
            begin = np.maximum.accumulate(begin)
            total, held, before = int(upto[-1]), group[:, -1], int(begin[-1])
            more = [pa.array(np.full(len(size), part, np.int32)), pa.array(nth + np.arange(len(size))), pa.array(upto), pa.array(upto - begin)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "part", "nth", "upto", "in_group"])
            nth += len(size)

    return rows.mapInArrow(run, _NUMBERED_SQL)


def _placed(docs: DataFrame, n_shards: int, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        common.content_key(text).alias("text_key"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    rows = common.written(rows, "shard-sizes")
    at = F.coalesce("doc_id", F.lit(_NULL_ID))
    many = rows.groupBy(*_GROUP).agg(F.min(at).alias("first_id"), F.count("*").alias("n"), F.sum("size").alias("group_bytes")).filter("n > 1").drop("n")
    many = common.written(many, "shard-groups")
    # groups with very many rows are joined by broadcast, the others by a shuffle; texts without copies need neither's columns
    hot = F.col("group_bytes") > rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0] // HOT_SHARES
    marked = rows.join(F.broadcast(many.filter(hot)), _GROUP, "left")
    cold = marked.filter("first_id is null").drop("first_id", "group_bytes").join(many.filter(~hot), _GROUP, "left")
    rows = marked.filter("first_id is not null").unionByName(cold)
    rows = rows.select("doc_id", *_GROUP, F.coalesce("first_id", at).alias("first_id"), F.coalesce("group_bytes", "size").alias("group_bytes"))
    rows = common.written(rows, "shard-ordered")
    order = ["first_id", *_GROUP, F.col("doc_id").asc_nulls_first()]
    rows = common.written(_numbered(rows.repartitionByRange(common.n_partitions(spark), *order).sortWithinPartitions(*order)), "shard-sums")
    # one row a range partition: what it holds, and the groups at its ends, which it may share with others
    of_group = F.struct(*_GROUP)
    parts = rows.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min_by(of_group, "upto").alias("first"), F.max_by(of_group, "upto").alias("last"), F.max_by("in_group", "upto").alias("tail"))
    base, b0, r0, carried, last = [], 0, 0, 0, None
    for r in parts.orderBy("part").collect():
        carried = carried if r["first"] == last else 0  # bytes of the first row's group in the partitions before
        base.append((r["part"], b0, r0, carried, *r["first"]))
        b0, r0, carried, last = b0 + r["bytes"], r0 + r["n"], r["tail"] + (carried if r["last"] == r["first"] else 0), r["last"]
    total = max(1, b0)
    rows = rows.join(F.broadcast(spark.createDataFrame(base, "part int, b0 long, r0 long, carried long, k0 long, k1 long, k2 long")), "part")
    upto = F.col("b0") + F.col("upto")
    goes_on = (F.col("text_key") == F.col("k0")) & (F.col("size") == F.col("k1")) & (F.col("text_crc32") == F.col("k2"))
    begin = upto - F.col("in_group") - F.when(goes_on, F.col("carried")).otherwise(0)
    whole = F.col("group_bytes") * (n_shards * WHOLE) <= total
    # the middle byte, twice: of the group where it stays whole, else of the row
    rows = rows.withColumn("middle", F.when(whole, 2 * begin + F.col("group_bytes")).otherwise(2 * upto - F.col("size")))
    shard = F.least(F.lit(n_shards - 1), F.expr(f"middle * {n_shards} div {2 * total}")).cast("int")
    placed = common.written(rows.select("doc_id", *_GROUP, shard.alias("shard"), (F.col("r0") + F.col("nth")).alias("row")), "shard-rows")
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first_row"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").withColumn("slot", F.col("row") - F.col("first_row"))


def assign_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law)."""
    placed = _placed(docs, n_shards, id_col, text_col)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> str:
    """All columns of ``docs`` as Parquet, one folder a shard, rows in slot order; returns the name of the folders' column."""
    folder = "__shard"
    while folder in docs.columns:
        folder += "_"
    columns = docs.columns
    rows = docs.toDF(*[f"x{i}" for i in range(len(columns))])  # whatever the names are, none clashes
    text = F.coalesce(F.col(f"x{columns.index(text_col)}").cast("string"), F.lit(""))
    rows = rows.withColumns({"id": F.col(f"x{columns.index(id_col)}").cast("long"), "key": common.content_key(text)})
    placed = _placed(docs, n_shards, id_col, text_col).select(F.col("doc_id").alias("p_id"), F.col("text_key").alias("p_key"), F.col("shard").alias(folder), "slot")
    copy = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*by))  # noqa: E731  of rows that are equal in id and text
    rows, placed = rows.withColumn("copy", copy("id", "key")), placed.withColumn("p_copy", copy("p_id", "p_key"))
    joined = rows.join(placed, F.col("id").eqNullSafe(F.col("p_id")) & (F.col("key") == F.col("p_key")) & (F.col("copy") == F.col("p_copy")))
    joined = joined.repartitionByRange(n_shards, folder, "slot").sortWithinPartitions(folder, "slot")
    joined.select(*[F.col(f"x{i}").alias(c) for i, c in enumerate(columns)], folder).write.partitionBy(folder).parquet(path)
    return folder
