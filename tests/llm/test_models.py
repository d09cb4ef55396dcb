import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkwarden.llm import common, langid, queries, toxicity

from .helpers import EDGE, SF, clashing, documents

MORE = "/root/testdata/sf0.01"


def crc(i):
    return zlib.crc32(str(i).encode())


def test_language_accuracy(spark):
    got = queries.op5_langid(spark, MORE).join(common.table(spark, MORE, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and all(r.held_out == (crc(r.doc_id) % 3 == 1) for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_of_odd_texts(spark):
    docs = documents(spark, EDGE)
    got = langid.identify(clashing(docs)).collect()
    assert len(got) == len(EDGE)
    for r in got:
        text = next(t for i, t in EDGE if i == r.doc_id)
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        assert r.score > 0 or r.lang_pred == "und" or r.lang_pred == "en"
    unknown = langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {(r.lang_pred, r.score) for r in unknown} == {("und", 0.0)}
    assert langid.identify(docs.limit(0)).count() == 0


def test_letters_alone_matter():
    b = langid.Bundler()
    one, two, three = b.bundle(["Ab cd", "aB,  CD!!", "12 ??"])
    assert (one == two).all() and not three.any()


def slow_vector(letter):
    """A letter's signs, by whole numbers: splitmix64's mixing, bit by bit."""
    m = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
        x = (x ^ x >> 27) * 0x94D049BB133111EB & m
        return x ^ x >> 31

    words = [mix(mix(ord(letter) + 1) + k * 0x9E3779B97F4A7C15 & m) for k in range(langid.DIMENSIONS // 64)]
    return [1 if words[d // 64] >> d % 64 & 1 else -1 for d in range(langid.DIMENSIONS)]


def slow_bundle(text, vectors):
    """Trigram by trigram, dimension by dimension, over letters with one blank between words."""
    line = " " + re.sub(r"[\W\d_]+", " ", text.lower()).strip() + " "
    n, out = langid.DIMENSIONS, [0] * langid.DIMENSIONS
    for a, b, c in zip(line, line[1:], line[2:], strict=False):
        a, b, c = (vectors.setdefault(x, None) or vectors.__setitem__(x, slow_vector(x)) or vectors[x] for x in (a, b, c))
        for d in range(n):
            out[d] += a[(d - 2) % n] * b[(d - 1) % n] * c[d]
    return out


def test_bundles_by_brute_force():
    texts = ["Der Hund bellt, laut!", "the quick brown fox jumps over the lazy dog", "el niño come", "x", "l'été 2020 arrive", "漢字 かな 漢字"] * 2
    vectors = {}
    got = langid.Bundler().bundle(texts)
    for t, v in zip(texts, got, strict=True):
        want = np.array(slow_bundle(t, vectors), float)
        assert abs(v - want / np.linalg.norm(want)).max() < 1e-6


def test_predictions_by_brute_force(spark):
    """Prototypes and cosines of a few documents, recomputed by the slow bundles."""
    texts = {"en": ["the dog runs over the hill", "and the cat sleeps in the sun"], "de": ["der hund rennt über den hügel", "und die katze schläft in der sonne"], "fr": ["le chien court sur la colline", "et le chat dort au soleil"]}
    rows = [(3 * k + i, t, lang) for k, (lang, both) in enumerate(texts.items()) for i, t in enumerate(both)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    vectors, unit = {}, lambda t: np.array(slow_bundle(t, vectors), float) / np.linalg.norm(slow_bundle(t, vectors))
    of = {i: unit(t) for i, t, _ in rows}
    profiles = {lang: sum(of[i] for i, _, x in rows if x == lang and crc(i) % 3 != 1) for lang in sorted(texts)}
    profiles = {k: v / np.linalg.norm(v) for k, v in profiles.items() if not isinstance(v, int)}
    for r in langid.identify(docs).collect():
        cosines = {k: float(of[r.doc_id] @ v) for k, v in profiles.items()}
        assert r.score == pytest.approx(max(0, min(1, max(cosines.values()))), abs=1e-5) and cosines[r.lang_pred] == pytest.approx(max(cosines.values()), abs=1e-6)


@pytest.mark.parametrize("keep, strip, shared", [(64, 16, 2), (64, 64, 1), (4096, 64, 99)])
def test_vector_table_overflows(monkeypatch, keep, strip, shared):
    texts = ["".join(chr(0x4E00 + i) for i in range(3000)), "hello there", None, "hello " * 30, "there, here"]
    want = langid.Bundler().bundle(texts)
    for name, value in (("KEEP", keep), ("STRIP", strip), ("SHARED", shared)):
        monkeypatch.setattr(langid, name, value)
    got = langid.Bundler()
    assert (got.bundle(texts) == want).all() and (got.bundle(texts) == want).all()


def test_toxicity_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op6_toxicity(spark, sf).join(common.table(spark, sf, "labels"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (crc(r.doc_id) % 5 == 0) for r in got)
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    caught = [r.predicted for r in held if r.toxic == 1]
    wrong = [r.predicted for r in held if r.toxic == 0]
    assert sum(caught) / len(caught) > 0.75 and sum(wrong) / len(wrong) < 0.02


def test_features_stay_in_their_text():
    text, place = toxicity.features(pa.array(["a b c", None, "c"]))
    assert sorted(text.tolist()) == [0] * 6 + [2]  # 3 words, 2 pairs, 1 skip-gram; then 1 word
    both = dict(zip(text.tolist(), place.tolist(), strict=True))
    assert both[2] in place[text == 0]


def slow_ftrl(documents, epochs):
    """FTRL-proximal with a dict of coordinates, one after the other. documents: (id, places, label)."""
    z, n = {}, {}
    bias = 1 << toxicity.HASH_BITS

    def weight(i):
        l1 = 0 if i == bias else toxicity.L1
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    documents = sorted(documents)
    for epoch in range(epochs):
        for i, places, label in sorted(documents, key=lambda d: zlib.crc32(f"{epoch}.{d[0]}".encode())):
            own = {k: weight(k) for k in [*places, bias]}
            g = 1 / (1 + math.exp(-sum(own.values()))) - label
            for k, w in own.items():
                z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA * w
                n[k] = n.get(k, 0.0) + g * g
    return {k: weight(k) for k in z if weight(k)}


def test_weights_and_scores_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    text = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    places = {i: set(toxicity.features(pa.array([t]))[1].tolist()) for i, t in text.items()}
    want = slow_ftrl([(i, sorted(places[i]), int(y)) for i, y in toxic.items() if crc(i) % 5 and i in text], toxicity.EPOCHS)
    got = dict(zip(*toxicity.train(docs, labels), strict=True))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    for r in toxicity.classify(docs, labels).collect():
        total = sum(want.get(k, 0) for k in places[r.doc_id]) + want[1 << toxicity.HASH_BITS]
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9)


def test_tuning_never_sees_held_out_rows(spark):
    """Labels of fold 0 turned round change no figure."""
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    other = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    settings = [(1, 1.0, 1.0, 1.0), (2, 3.0, 10.0, 0.1)]
    assert toxicity.tune(docs, labels, settings) == toxicity.tune(docs, other, settings)


def test_sample_is_bounded_by_features_too(labelled):
    rows = toxicity.sampled(*labelled).toArrow().to_batches()
    ids, places, y = toxicity.bounded(iter(rows), 100)
    assert 0 < sum(map(len, places)) <= 100 and ids == sorted(ids) and len(ids) == len(y) == len(places)


def test_rows_that_share_an_id_are_learnt_once(spark, labelled):
    docs, labels = labelled
    assert toxicity.train(docs.union(docs), labels) == toxicity.train(docs, labels)


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(i, f"you are scum number{i}" if i % 3 == 0 else f"a kind word number{i}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (5, None), (9999, 1)], "doc_id long, toxic int")
    return documents(spark, rows), labels


def test_reject_keeps_clean_rows_whole(labelled):
    docs, labels = labelled
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect())) == sorted(tuple(r) for r in docs.collect() if r.doc_id % 3)


def test_scores_of_odd_texts(spark, labelled):
    model = toxicity.train(*labelled)
    got = toxicity.scores(clashing(documents(spark, EDGE)), model).collect()
    of = {r.doc_id: r.score for r in got}
    assert len(got) == len(EDGE) and of[1] == of[2] == of[3] and of[10] > 0.5
    assert toxicity.classify(documents(spark, []), labelled[1]).count() == 0
    none = toxicity.classify(labelled[0], labelled[1].limit(0)).collect()
    assert len(none) == 300 and not any(r.predicted for r in none)


def test_sample_is_bounded(labelled):
    model = toxicity.train(*labelled, sample=20)
    assert model[0] and len(model[0]) < 1000
