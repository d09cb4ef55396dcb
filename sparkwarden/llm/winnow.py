"""Document fingerprints by winnowing, in DataFrame functions alone.

A window of GRAM code points moves over the text, in UTF-32 so that each step is four bytes,
and its XXH64 is taken at every position. Of every WINDOW neighbouring gram hashes the
least is chosen, the rightmost of equals, and kept with its position. So two texts that
share GRAM + WINDOW - 1 characters in a row share a chosen gram, wherever the characters stand and
whether or not the language puts spaces between words, and what is chosen depends on those characters alone.

A minimum is taken over longs: the upper half of a gram's hash above, 32 bits that
fall as the position rises below, so that the least is the least half hash and among equals the rightmost.
Minima of 16 come from minima of 8, these from minima of 4 and so on, each by one pass. What is kept of a chosen gram is its whole 64-bit
hash, its position and the first window that chose it. A text is worked through in spans of SPAN windows, so that
what is in memory at once is a span and the chosen grams, however long the text.

An edited text shares characters with two others, so its chosen grams are theirs where a window lies in the shared
part; only the windows across the seam, at most 2 (GRAM + WINDOW) characters, are taken anew.

Defined results: texts with fewer code points than GRAM have one gram, of all of them; an empty or null text has
none and an empty fingerprint, alike only to another empty one (likeness 1). Rows with equal ids are ordered by a hash of the
text, then the text; a null id counts as the smallest. A sole document is its own next. Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Code points of a gram, grams of a window (a power of two), and grams of a span.
GRAM, WINDOW, SPAN = 8, 16, 1 << 14
#: Rows of an id from which its rows are dealt over several parts, or a larger share of all rows.
HOT_ROWS = 10_000
_NULL_ID = -(1 << 63)
_LOW = (1 << 32) - 1


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _gram(utf32: Column, position: Column) -> Column:
    return F.xxhash64(F.substring(utf32, position * 4 + 1, F.lit(4 * GRAM)))


def _minima(grams: Column) -> Column:
    """For an array of longs, the least of each WINDOW neighbours, or of those that there are."""

    def pass_by(step: int) -> Callable[[Column], Column]:
        return lambda x: F.zip_with(x, F.slice(x, step + 1, F.greatest(F.size(x) - step, F.lit(0))), lambda a, b: F.least(a, b))  # of a long and null: the long

    out, step = F.array(grams), 1
    while step < WINDOW:
        out, step = F.transform(out, pass_by(step)), 2 * step
    return F.element_at(out, 1)


CHOSEN_SQL = "array<struct<hash:bigint,position:int,window:int>>"


def _chosen(utf32: Column) -> Column:
    """The chosen grams in order of position: hash, position and number of the first window that chose it."""
    last = F.greatest((F.octet_length(utf32) / 4).cast("int") - GRAM, F.lit(0))  # of the grams' positions

    def span(begin: Column) -> Column:
        def pack(i: Column) -> Column:
            return _gram(utf32, i).bitwiseAND(F.lit(-(1 << 32))).bitwiseOR(F.lit(_LOW) - i)

        def of_minima(m: Column) -> Column:
            # minima at a span's end are of fewer grams, and so cut, unless the text ends there
            starts = F.sequence(F.lit(0), F.greatest(F.size(m) - WINDOW, F.lit(0)))
            starts = F.filter(starts, lambda j: (j == 0) | (F.get(m, j) != F.get(m, j - 1)))
            position = lambda j: (F.lit(_LOW) - F.get(m, j).bitwiseAND(F.lit(_LOW))).cast("int")
            return F.transform(starts, lambda j: F.struct(_gram(utf32, position(j)).alias("hash"), position(j).alias("position"), (begin + j).alias("window")))

        grams = F.transform(F.sequence(begin, F.least(begin + F.lit(SPAN + WINDOW - 2), last)), pack)
        return _let(_minima(grams), of_minima)

    spans = F.transform(F.sequence(F.lit(0), F.greatest(last - (WINDOW - 1), F.lit(0)), F.lit(SPAN)), span)
    # a span's first window may choose what the span before has chosen
    whole = _let(F.flatten(spans), lambda x: F.filter(x, lambda v, i: (i == 0) | (v["position"] != F.get(x, i - 1)["position"])))
    return F.when(F.octet_length(utf32) > 0, whole).otherwise(F.array().cast(CHOSEN_SQL))


def chosen(text: Column) -> Column:
    """array of struct(hash, position, window): the chosen grams in order of position, and the first window that chose each; both count code points from 0."""
    return _let(F.encode(F.coalesce(text, F.lit("")), "UTF-32"), _chosen)


_ACROSS = GRAM + WINDOW - 2


def _edited_chosen(own: Column, following: Column, edited: Column, kept: Column, taken: Column) -> Column:
    """What ``chosen`` gives for an edited text: ``kept`` code points of a text whose chosen grams are ``own``, then ``taken`` of one with ``following``."""
    begin = F.greatest(kept - _ACROSS, F.lit(0))
    across = F.substring(edited, begin + 1, kept - begin + F.least(taken, F.lit(_ACROSS)))

    def moved(x: Column, by: Column) -> Column:
        return F.transform(x, lambda v: F.struct(v["hash"].alias("hash"), (v["position"] + by).alias("position"), (v["window"] + by).alias("window")))

    def followed(x: Column, y: Column) -> Column:
        """x and what of y comes after it."""
        last = F.coalesce(F.get(x, F.size(x) - 1)["position"], F.lit(-1))
        return F.concat(x, _let(last, lambda p: F.filter(y, lambda v: v["position"] > p)))

    first = F.filter(own, lambda v: v["window"] < kept - _ACROSS)
    seam = F.when(F.length(across) > _ACROSS, moved(chosen(across), begin)).otherwise(F.array().cast(CHOSEN_SQL))
    rest = moved(F.filter(following, lambda v: v["window"] < taken - _ACROSS), kept)
    joined = _let(_let(first, lambda x: followed(x, seam)), lambda x: followed(x, rest))
    return F.when(kept + taken > _ACROSS, joined).otherwise(chosen(edited))


def _hashes(chosen_col: str) -> Column:
    return F.transform(chosen_col, lambda v: v["hash"])


def _printed(hashes_col: str) -> Column:
    """16 hex digits for each chosen hash, in order of position."""
    return F.lower(F.concat_ws("", F.transform(hashes_col, lambda v: F.lpad(F.hex(v), 16, "0"))))


def likeness(a: str, b: str) -> Column:
    """Jaccard of two arrays of distinct hashes; two empty ones are alike."""
    shared = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either).cast("double")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and grams: array of struct(hash, position, window), as ``chosen`` has it."""
    return common.key_text(docs, id_col, text_col).select("doc_id", chosen(F.col("text")).alias("grams"))


def _parts(rows: DataFrame) -> DataFrame:
    """``rows`` with part: ascending in order of ``at`` and ``text_key``, of like sizes; an id with very many rows has several."""
    n = common.n_partitions(rows.sparkSession)
    counts = rows.groupBy("at").count()
    limit = max(HOT_ROWS, rows.count() // n)
    heavy = [r["at"] for r in counts.filter(F.col("count") > limit).collect()]  # fewer than n
    bounds = sorted({*common.range_bounds(rows.select("at"), "at", 4 * n), *heavy, *(max(h - 1, _NULL_ID) for h in heavy)})
    part = common.bucket_of(F.col("at"), bounds) * n
    if heavy:
        place = (F.shiftright("text_key", 48) + (1 << 15)) * n
        part = part + F.when(F.col("at").isin(heavy), F.shiftright(place, 16)).otherwise(0)
    return rows.withColumn("part", part.cast("int"))


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text and against the next one.

    The next document is the one before it in ascending order of id (the
    last for the first). Rows are dealt by ranges of the id; the last row of
    each range is repeated at the front of the range after it, where it only
    lends its text and hashes.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = common.key_text(docs, id_col, text_col).select("doc_id", F.coalesce("doc_id", F.lit(_NULL_ID)).alias("at"), text.alias("text"), common.content_key(text).alias("text_key"))
    rows = _parts(rows)
    last = {r["part"]: r["last"] for r in rows.groupBy("part").agg(F.max(F.struct("at", "text_key")).alias("last")).collect()}  # one row a part
    used = sorted(last)
    lenders = [(*last[p], q) for p, q in zip([used[-1], *used[:-1]], used, strict=True)] if used else []
    lenders = spark.createDataFrame(lenders, "at long, text_key long, part int")  # one row a part
    lent = rows.drop("part", "doc_id").join(F.broadcast(lenders), ["at", "text_key"]).groupBy("at", "text_key", "part").agg(F.max("text").alias("text"))
    both = rows.withColumn("own", F.lit(True)).unionByName(lent.withColumns({"doc_id": F.lit(None).cast("long"), "own": F.lit(False)}))
    order = Window.partitionBy("part").orderBy("own", "at", "text_key", "text")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = both.withColumn("next_text", F.lag("text", 1, "").over(order))  # first, so that grams are taken after the shuffle
    df = df.withColumns({"n_chars": F.length("text").cast("long"), "c0": chosen(F.col("text"))})
    df = df.withColumn("next_chosen", F.lag("c0", 1).over(order)).filter("own")  # the same parts and order: no further shuffle or sort
    kept = (F.col("n_chars") - half).cast("int")
    df = df.withColumn("end", F.substring("next_text", F.lit(1), half)).withColumn("edited", F.concat(F.substring("text", F.lit(1), kept), "end"))

    def of(x: Column) -> Column:  # whatever stands in a lambda is computed for every gram, so these are bound before
        return _edited_chosen(F.col("c0"), F.col("next_chosen"), x["edited"], x["kept"], x["taken"])

    df = df.withColumn("c1", _let(F.struct("edited", kept.alias("kept"), F.length("end").alias("taken")), of))
    df = df.withColumn("edited_sha256", F.sha2("edited", 256))
    df = df.select("doc_id", "n_chars", "edited_sha256", _hashes("c0").alias("f0"), _hashes("c1").alias("f1"), _hashes("next_chosen").alias("f2"))
    df = df.select("*", *[F.array_distinct(f"f{k}").alias(f"h{k}") for k in range(3)])
    return df.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        _printed("f0").alias("fingerprint"),
        _printed("f1").alias("edited_fingerprint"),
        likeness("h0", "h1").alias("near_edited"),
        likeness("h0", "h2").alias("near_next"),
    )
