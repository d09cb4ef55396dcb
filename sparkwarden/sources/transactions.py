"""Transactions, labelled references and queries made from an event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
MCC_OF_REMAINDER = ["5411", "5812", "5912", "5944", "7801", "7802", "7995", "4511", "5311", "5999", "0000"]
DAY = 86_400_000_000


def transactions(spark: SparkSession, sf_dir: str, hot: bool = False) -> DataFrame:
    """One row an event, in the columns that a parsed payload has, and a label.

    ``hot``: the customer's average is a tenth, so that the borderline rule
    has something to do.
    """
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("tx_id"),
        F.col("user_id").alias("customer_id"),
        F.col("ts").cast("timestamp").alias("requested_at"),
        "event_type",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        (F.round(F.col("value") * 100).cast("long") * 20).alias("amount_cents"),
    )
    user = Window.partitionBy("customer_id")
    before = user.orderBy("requested_at", "tx_id")
    day = user.orderBy(F.unix_micros("requested_at")).rangeBetween(-DAY, 0)
    visits = Window.partitionBy("customer_id", "k").orderBy("requested_at", "tx_id")
    average = F.sum("amount_cents").over(user).cast("double") / F.count("*").over(user) / 100
    mcc = F.element_at(F.array(*map(F.lit, MCC_OF_REMAINDER)), F.col("k") % 11 + 1)
    online = F.col("event_type").isin("click", "view", "signup")
    last = F.lag("requested_at").over(before)
    out = ev.select(
        "tx_id",
        "customer_id",
        "requested_at",
        "amount_cents",
        (F.col("amount_cents").cast("double") / 100).alias("amount"),
        (average / 10 if hot else average).alias("customer_avg_amount"),
        (1 + F.col("tx_id") % 12).cast("int").alias("installments"),
        F.count("*").over(day).cast("int").alias("tx_count_24h"),
        F.concat(F.lit("MERC-"), F.lpad(F.col("k").cast("string"), 3, "0")).alias("merchant_id"),
        (F.row_number().over(visits) > 1).alias("merchant_known"),
        mcc.alias("mcc"),
        (F.lit(100) + 37 * F.col("k")).cast("double").alias("merchant_avg_amount"),
        online.alias("is_online"),
        (F.col("event_type") == "purchase").alias("card_present"),
        ((F.col("tx_id") * 7919 % 15000).cast("double") / 10).alias("km_from_home"),
        last.alias("last_timestamp"),
        F.when(last.isNotNull(), (F.col("tx_id") * 104729 % 12000).cast("double") / 10).alias("km_from_current"),
    )
    return out.withColumn("label", (((F.col("amount") >= 1500) | (F.col("km_from_home") > 1000)) & F.col("is_online")).cast("int"))


def is_query(tx_id: str = "tx_id"):
    """The stated query set: every id divisible by 20, against all rows as references."""
    return F.col(tx_id) % 20 == 0


def payload_json(tx: DataFrame) -> DataFrame:
    """tx_id and the JSON payload of each transaction; the known merchants are the merchant itself, or none."""
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    known = F.when(F.col("merchant_known"), F.array("merchant_id")).otherwise(F.array().cast("array<string>"))
    body = F.struct(
        F.concat(F.lit("tx-"), F.col("tx_id").cast("string")).alias("id"),
        F.struct("amount", "installments", stamp("requested_at").alias("requested_at")).alias("transaction"),
        F.struct(F.col("customer_avg_amount").alias("avg_amount"), "tx_count_24h", known.alias("known_merchants")).alias("customer"),
        F.struct(F.col("merchant_id").alias("id"), "mcc", F.col("merchant_avg_amount").alias("avg_amount")).alias("merchant"),
        F.struct("is_online", "card_present", "km_from_home").alias("terminal"),
        F.when(F.col("last_timestamp").isNotNull(), F.struct(stamp("last_timestamp").alias("timestamp"), "km_from_current")).alias("last_transaction"),
    )
    return tx.select("tx_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("payload"))
