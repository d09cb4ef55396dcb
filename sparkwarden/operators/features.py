"""The 14 features of a transaction as single-precision columns s0..s13."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import MISSING, clamp01, epoch_minutes, mcc_risk, weekday_monday0

# Fixed values.
MAX_AMOUNT, MAX_INSTALLMENTS, MAX_AMOUNT_RATIO, MAX_MINUTES, MAX_KM, MAX_TX_24H, MAX_MERCHANT_AVG = 10000.0, 12.0, 10.0, 1440.0, 1000.0, 20.0, 10000.0
NIGHT_HOUR, FEW_TX, HIGH_RATIO = 6, 4, 9.0


def _per(x: Column, most: float) -> Column:
    return clamp01(x.cast("double") / F.lit(most))


def _flag(x: Column) -> Column:
    return x.cast("float")


def minutes_since_last() -> Column:
    """Whole minutes since the last transaction, 0 if that lies ahead; null without one."""
    return F.greatest(epoch_minutes(F.col("requested_at")) - epoch_minutes(F.col("last_timestamp")), F.lit(0))


def feature_columns() -> list[Column]:
    missing = F.lit(MISSING).cast("float")
    no_last = F.col("last_timestamp").isNull()
    ratio = F.when(F.col("customer_avg_amount") <= 0, F.lit(1.0).cast("float")).otherwise(clamp01(F.col("amount") / F.col("customer_avg_amount") / F.lit(MAX_AMOUNT_RATIO)))
    columns = [
        ratio,
        F.when(no_last, missing).otherwise(_per(F.col("km_from_current"), MAX_KM)),
        mcc_risk(F.col("mcc")),
        F.when(no_last, missing).otherwise(_per(minutes_since_last(), MAX_MINUTES)),
        _flag(~F.col("merchant_known")),
        _per(F.col("tx_count_24h"), MAX_TX_24H),
        _per(F.col("km_from_home"), MAX_KM),
        _per(F.col("amount"), MAX_AMOUNT),
        _per(F.col("merchant_avg_amount"), MAX_MERCHANT_AVG),
        _flag(F.col("is_online")),
        _flag(F.col("card_present")),
        (F.hour("requested_at").cast("double") / F.lit(23.0)).cast("float"),
        (weekday_monday0(F.col("requested_at")).cast("double") / F.lit(6.0)).cast("float"),
        _per(F.col("installments"), MAX_INSTALLMENTS),
    ]
    return [c.alias(f"s{i}") for i, c in enumerate(columns)]


def borderline() -> Column:
    """Whether two fraud neighbours are to count as three."""
    ratio = F.when(F.col("customer_avg_amount") > 0, F.col("amount") / F.col("customer_avg_amount"))
    odd = ~F.col("merchant_known") & F.col("is_online") & ~F.col("card_present") & (F.col("tx_count_24h") <= FEW_TX) & (F.hour("requested_at") <= NIGHT_HOUR)
    return F.coalesce(odd & (ratio >= HIGH_RATIO), F.lit(False))


def features(tx: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns, s0..s13 and borderline."""
    return tx.select(*keep, *feature_columns(), borderline().alias("borderline"))
