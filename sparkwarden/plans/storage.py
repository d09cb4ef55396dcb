"""Tables kept between the steps of a plan."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Paths of the tables that were kept, by the ``settled`` calls that are under way.
_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    A temporary folder takes its place only where the setting is absent and
    the session has no other machine, as in tests; on a cluster that is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    jvm_context = spark.sparkContext._jsc.sc()
    if not jvm_context.getCheckpointDir().isDefined():
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkwarden-"))
    return jvm_context.getCheckpointDir().get().rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back.

    This cuts the lineage: an executor lost later costs no recomputation of
    what is before, and a plan used twice runs once.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, as a table of its own; the tables that it kept on its way are deleted."""
    _scopes.append([])
    try:
        df = make()
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        schema = df.schema
    finally:
        own = _scopes.pop()
        for x in own:
            delete(spark, x)
    if _scopes:
        _scopes[-1].append(path)
    return spark.read.schema(schema).parquet(path)
