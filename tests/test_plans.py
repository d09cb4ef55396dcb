"""Plans that must hold at any size: what is read, and what is shuffled."""

import re

from pyspark.sql import functions as F

from sparkwarden.functions import scalar
from sparkwarden.operators import features, knn
from sparkwarden.plans import catalogue
from sparkwarden.sources import transactions as tx

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_needed_columns_are_read(spark):
    assert "ReadSchema: struct<event_id:bigint,value:double>" in plan(catalogue.clamp_normalize(spark, SF))
    assert "ReadSchema: struct<value:double>" in plan(catalogue.latency_p99_score(spark, SF))


def test_features_stay_in_generated_code(spark):
    t = tx.transactions(spark, SF)
    t.write.parquet(path := spark.conf.get("spark.checkpoint.dir") + "/plan-tx")
    text = plan(features.features(spark.read.parquet(path), "tx_id").select("tx_id", *[scalar.quantize(F.col(s)) for s in scalar.SLOTS]))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


def test_references_are_never_shuffled(spark):
    f = features.features(tx.transactions(spark, SF), "tx_id", "label")
    refs = f.select(F.col("tx_id").alias("ref_id"), "label", *[scalar.quantize(F.col(s)).alias(s) for s in scalar.SLOTS])
    refs.write.parquet(path := spark.conf.get("spark.checkpoint.dir") + "/plan-refs")
    queries = f.filter(tx.is_query()).withColumnRenamed("tx_id", "qid")
    text = plan(knn.kernel(queries, spark.read.parquet(path)))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1 and "MapInArrow" in text and "WindowGroupLimit" in text
    assert text.index("Exchange hashpartitioning") < text.index("MapInArrow")  # only what the kernel found is shuffled
