"""Column expressions: clamping, quantizing, dates, look-ups and distances.

All of them are built-in expressions, so they stay inside generated code.
Values that are single precision by contract are cast after every step, as
Spark's division widens to double.
"""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values.
#: Merchant category -> risk.
MCC_RISK = {
    "5411": 0.15,
    "5812": 0.30,
    "5912": 0.20,
    "5944": 0.45,
    "7801": 0.80,
    "7802": 0.75,
    "7995": 0.85,
    "4511": 0.35,
    "5311": 0.25,
    "5999": 0.50,
}
DEFAULT_RISK = 0.5
QUANT_SCALE = 65534
QUANT_MISSING = 65535
MISSING = -1.0
DIM = 14
SLOTS = [f"s{i}" for i in range(DIM)]
#: Position of each slot's feature in the published order of a labelled vector.
SPEC_OF_SLOT = [2, 6, 12, 5, 11, 8, 7, 0, 13, 9, 10, 3, 4, 1]


def _float(x: float) -> Column:
    return F.lit(x).cast("float")


def clamp01(x: Column) -> Column:
    """0 to 1 in single precision; NaN stays NaN, as a comparison with it is never true."""
    d = x.cast("double")
    return F.when(F.isnan(d), d).otherwise(F.least(F.greatest(d, F.lit(0.0)), F.lit(1.0))).cast("float")


def quantize(x: Column) -> Column:
    """16 bits as int: 0 to 65534, or 65535 for a missing (negative) value."""
    scaled = (clamp01(x) * _float(QUANT_SCALE)).cast("double")
    return F.when(x < 0, QUANT_MISSING).otherwise((scaled + 0.5).cast("int"))  # what round() gives for these numbers, but not through decimals


def dequantize(q: Column) -> Column:
    step = float(np.float32(1) / np.float32(QUANT_SCALE))
    return F.when(q == QUANT_MISSING, _float(MISSING)).otherwise(q.cast("float") * _float(step))


def pack(vector: Column) -> list[Column]:
    """The 14 quantized slots of an array in published order."""
    return [quantize(vector[spec]).alias(slot) for slot, spec in zip(SLOTS, SPEC_OF_SLOT, strict=True)]


def unpack(prefix: str = "") -> list[Column]:
    """The 14 dequantized slots of quantized slot columns."""
    return [dequantize(F.col(f"{prefix}{s}")).alias(s) for s in SLOTS]


def mcc_risk(mcc: Column) -> Column:
    """Risk by category; an unknown or null one has DEFAULT_RISK."""
    out = F.lit(DEFAULT_RISK)
    for code, risk in MCC_RISK.items():
        out = F.when(mcc == code, risk).otherwise(out)
    return out.cast("float")


def mcc_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MCC_RISK.items()), "mcc string, risk double")


def join_mcc_risk(df: DataFrame, mcc_col: str = "mcc") -> DataFrame:
    """The relational form of ``mcc_risk``: a left join with a table of ten rows."""
    risks = F.broadcast(mcc_table(df.sparkSession))
    return df.join(risks, df[mcc_col] == risks["mcc"], "left").select(*[df[c] for c in df.columns if c != "mcc_risk"], F.coalesce(risks["risk"], F.lit(DEFAULT_RISK)).cast("float").alias("mcc_risk"))


def weekday_monday0(ts: Column) -> Column:
    return F.weekday(ts)


def epoch_days(ts: Column) -> Column:
    return F.unix_date(F.to_date(ts))


def epoch_minutes(ts: Column) -> Column:
    """Whole minutes since 1970; differences are of whole minutes, not of seconds."""
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(60_000_000))


def iso_timestamp(text: Column) -> Column:
    """A timestamp from exactly dddd-dd-ddTdd:dd:ddZ, or null."""
    exact = text.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}Z$") & (F.length(text) == 20)
    return F.when(exact, F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def equal_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(a) == F.lower(b)


def distance_sq(left: list[Column], right: list[Column]) -> Column:
    """Squared distance in single precision, added in slot order."""
    return reduce(add, [(a - b) * (a - b) for a, b in zip(left, right, strict=True)])


def slots(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{s}") for s in SLOTS]


def lower_bound_sq(centre_distance: Column, radius: Column) -> Column:
    """Least squared distance from a query to a point of a list."""
    gap = F.greatest(centre_distance - radius, F.lit(0.0))
    return gap * gap


def pseudo_random(id_col: Column, seed: int) -> Column:
    """A repeatable order of rows."""
    return F.xxhash64(id_col, F.lit(seed))
