"""Toxicity by FTRL-proximal logistic regression over hashed word features.

Features: single words, pairs of neighbours, and skip-grams (a word with the next
but one), lower-cased and without punctuation, hashed to 2^HASH_BITS places; a
document has a feature or not. Weights follow FTRL-proximal with a rate for
each coordinate; its L1 term leaves most weights exactly 0, so the model is a
short list of places and weights, at most 2^HASH_BITS of them, that every
task gets.

Training reads a bounded sample of the labelled rows: SAMPLE of them in expectation, those with the
smallest hashes of doc_id, all of them if there are fewer, and of these as many, in order of those hashes, as have
SAMPLE_PLACES features in all. Scores read every whole text.

EPOCHS, ALPHA, L1 and L2 were chosen by ``tune``, which splits the rows that may be learnt from once more: it learns
from those with crc32 mod FOLDS of 1, 2 and 3 and measures the log loss on those with 4. Rows with 0 are read by neither.

Defined results: null and empty texts get the score of the bias alone. Label
rows with a null id or label, or with an id that no document has, are not
learnt from; repeated label rows count once (as toxic, if one is), and of rows that share an id one counts. With no label at all every score
is 0.5 minus a hair and nothing is predicted toxic. Rows come back one each;
other columns pass through ``reject`` as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

HASH_BITS = 20
SAMPLE = 16_384
SAMPLE_PLACES = 32 << 20
EPOCHS = 4
ALPHA, BETA, L1, L2 = 3.0, 1.0, 10.0, 0.01
FOLDS = 5
_PAIR, _SKIP = (np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS


def held_out(id_col: Column) -> Column:
    """Rows that training must not see: those of fold 0."""
    return fold(id_col) == 0


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of every feature occurrence."""
    w = wordhash.words(texts, wordhash.ALNUM)
    h = w.hashes()
    text = np.repeat(np.arange(len(texts)), np.diff(w.first))
    shift = np.uint64(64 - HASH_BITS)
    with np.errstate(over="ignore"):
        pair = wordhash.mix(h[:-1] * _PAIR + h[1:])
        skip = wordhash.mix(h[:-2] * _SKIP + h[2:])
    one, two = text[:-1] == text[1:], text[:-2] == text[2:]
    return np.concatenate([text, text[:-1][one], text[:-2][two]]), np.concatenate([h >> shift, pair[one] >> shift, skip[two] >> shift]).astype(np.int64)


def _distinct(text: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(text << HASH_BITS | place)
    return key >> HASH_BITS, key & ((1 << HASH_BITS) - 1)


class Ftrl:
    """Weights of one logistic regression; place 2^HASH_BITS is the bias, free of L1."""

    def __init__(self, alpha: float = ALPHA, l1: float = L1, l2: float = L2):
        self.z, self.n = np.zeros((1 << HASH_BITS) + 1), np.zeros((1 << HASH_BITS) + 1)
        self.alpha, self.l2 = alpha, l2
        self.l1 = np.full((1 << HASH_BITS) + 1, l1)
        self.l1[-1] = 0

    def weights(self, at) -> np.ndarray:
        z = self.z[at]
        return np.where(np.abs(z) <= self.l1[at], 0.0, -(z - np.sign(z) * self.l1[at]) / ((BETA + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w, n = self.weights(at), self.n[at]
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def order_of(ids: list[int], epoch: int) -> list[int]:
    """Positions of ascending ids in the order in which an epoch takes them."""
    return sorted(range(len(ids)), key=lambda k: zlib.crc32(b"%d.%d" % (epoch, ids[k])))


def fitted(ids: list[int], places: list[np.ndarray], labels: list[int], epochs: int = EPOCHS, alpha: float = ALPHA, l1: float = L1, l2: float = L2) -> Ftrl:
    """A model of documents in order of their ids, each with the places of its features and its label."""
    model, bias = Ftrl(alpha, l1, l2), 1 << HASH_BITS
    places = [np.append(p, bias) for p in places]
    for epoch in range(epochs):
        for k in order_of(ids, epoch):
            model.learn(places[k], labels[k])
    return model


SAMPLED_SQL = "id long, label int, places array<int>"


def sampled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """id, label and places of the labelled documents that are learnt from, one row an id, in one partition in order of the ids' hashes."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    rows = known.count()
    if rows > sample:  # so many in expectation: a bound on hashes needs no sort
        known = known.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * sample / rows))
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id")  # about ``sample`` ids

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            text, place = _distinct(*features(batch.column(1)))
            at = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.cast(pc.greater(batch.column(2), 0), pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(place.astype(np.int32)))], names=["id", "label", "places"])

    found = wanted.select("id", "text", "label").mapInArrow(extract, SAMPLED_SQL)
    one = found.groupBy("id").agg(F.min(F.struct("label", "places")).alias("row")).select("id", "row.label", "row.places")  # rows may share an id
    order = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    return one.repartition(1).sortWithinPartitions(order, "id")


def bounded(batches: Iterator[pa.RecordBatch], limit: int = SAMPLE_PLACES) -> tuple[list[int], list[np.ndarray], list[int]]:
    """ids, places and labels of the first rows that have at most ``limit`` places together, in order of the ids."""
    ids, places, labels, held = [], [], [], 0
    for batch in batches:
        lists = batch.column(2)
        at, value = lists.offsets.to_numpy(), lists.values.to_numpy()
        for k, (i, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            own = value[at[k] : at[k + 1]]
            if held + len(own) <= limit:
                held += len(own)
                ids.append(i)
                places.append(own.copy())
                labels.append(y)
    order = sorted(range(len(ids)), key=ids.__getitem__)
    return [ids[k] for k in order], [places[k] for k in order], [labels[k] for k in order]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[int], list[float]]:
    """Places and weights that aren't 0; the last place is the bias."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, places, y = bounded(batches)
        if ids:
            w = fitted(ids, places, y).weights(slice(None))
            used = np.flatnonzero(w)
            yield pa.RecordBatch.from_arrays([pa.array([used.tolist()], pa.list_(pa.int64())), pa.array([w[used].tolist()], pa.list_(pa.float64()))], names=["places", "weights"])

    found = sampled(docs, labels, sample, id_col, text_col, label_col).mapInArrow(fit, "places array<long>, weights array<double>").collect()  # one row, at most 2^HASH_BITS numbers
    return (list(found[0]["places"]), list(found[0]["weights"])) if found else ([1 << HASH_BITS], [-1e-9])


def tune(docs: DataFrame, labels: DataFrame, settings: list[tuple[int, float, float, float]], check_fold: int = FOLDS - 1, sample: int = SAMPLE) -> list[tuple[tuple[int, float, float, float], float, int, int]]:
    """For each (epochs, alpha, l1, l2): itself, log loss, toxic documents missed and others marked among the rows of ``check_fold``, learning from the other folds.

    Fold 0 is in neither part. Settings are tried side by side, one task each.
    """
    spark = docs.sparkSession
    rows = common.written(sampled(docs, labels, sample), "tuning-sample")
    data = bounded(iter(rows.toArrow().to_batches()))  # at most SAMPLE_PLACES numbers
    check = {r["id"] for r in rows.filter(fold(F.col("id")) == check_fold).select("id").collect()}
    sent = spark.sparkContext.broadcast((data, check))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (ids, places, y), check = sent.value
        learn = [k for k, i in enumerate(ids) if i not in check]
        for batch in batches:
            for n, epochs, *rates in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = fitted([ids[k] for k in learn], [places[k] for k in learn], [y[k] for k in learn], epochs, *rates).weights(slice(None))
                total = np.array([w[places[k]].sum() + w[-1] for k, i in enumerate(ids) if i in check])
                truth = np.array([y[k] for k, i in enumerate(ids) if i in check], bool)
                loss = float(np.logaddexp(0, np.where(truth, -total, total)).mean())
                yield pa.RecordBatch.from_pylist([{"n": n, "loss": loss, "missed": int((truth & (total < 0)).sum()), "marked": int((~truth & (total >= 0)).sum())}])

    asked = spark.createDataFrame([(n, *x) for n, x in enumerate(settings)], "n int, epochs int, alpha double, l1 double, l2 double").repartition(len(settings), "n")
    got = asked.mapInArrow(one, "n long, loss double, missed long, marked long").collect()
    return [(settings[r["n"]], r["loss"], r["missed"], r["marked"]) for r in sorted(got, key=lambda r: r["loss"])]


def scorer(model: tuple[list[int], list[float]]):
    """texts -> scores, for use in a task."""
    dense = np.zeros((1 << HASH_BITS) + 1)
    dense[np.array(model[0], np.int64)] = model[1]
    used = dense != 0

    def score(texts: pa.Array) -> np.ndarray:
        text, place = features(texts)
        keep = used[place]
        text, place = _distinct(text[keep], place[keep])
        total = np.bincount(text, dense[place], len(texts)) + dense[-1]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))

    return score


def scores(docs: DataFrame, model: tuple[list[int], list[float]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        for batch in common.slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    return common.key_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= 0.5)."""
    found = scores(docs, train(docs, labels, id_col=id_col, text_col=text_col), id_col, text_col)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score is under 0.5."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, id_col=id_col, text_col=text_col))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(shared.value)
        for batch in common.slices(batches, at):
            yield batch.filter(pa.array(score(batch.column(at)) < 0.5))

    return docs.mapInArrow(run, docs.schema)
