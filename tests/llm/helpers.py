"""Inputs that every operator must bear."""

from pyspark.sql import DataFrame, SparkSession

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 997} of{i % 31}" for i in range(60_000))


def documents(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text) rows as a documents table."""
    return spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def clashing(df: DataFrame) -> DataFrame:
    """``df`` with columns named like those that operators make."""
    from pyspark.sql import functions as F

    names = "size shard part at fp key c l r rep_doc score held_out n_tokens frame words own __id component_id fingerprint segment nth word id".split()
    return df.withColumns({n: F.lit(-7) for n in names if n not in df.columns})


EDGE = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "One two  three\nfour's 12½ ÉCOLE 漢字🙂  x\x1cy z"),
    (6, "repeat me " * 400),
    (7, "repeat me " * 400),
    (7, "repeat me " * 400),
    (None, "no id here at all"),
    (8, LONG),
    (9, "aaaaaaaaaa" * 3000),
    (10, "idiot \x00 scum"),
]
