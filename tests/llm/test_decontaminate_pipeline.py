import hashlib
import re

import duckdb
import numpy as np
import public_tokenizers as P
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sparkwarden.llm import common, decontaminate, queries, simhash, substring, toxicity

from .helpers import EDGE, SF, clashing, documents

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def slow(docs, items, window=13):
    at = {}
    for i, t in items:
        w = words(t)
        for k in range(len(w) - window + 1) if len(w) >= window else range(1 if w else 0):
            at.setdefault(tuple(w[k : k + window]), set()).add("" if i is None else str(i))
    out = []
    for d, t in docs:
        w, met = words(t), set()
        hit = [0] * len(w)
        for n in {len(k) for k in at}:
            for k in range(len(w) - n + 1):
                if found := at.get(tuple(w[k : k + n])):
                    met |= found
                    hit[k : k + n] = [1] * n
        out.append((d, len(w), sum(hit), sorted(met), sum(hit) > 0 and 20 * sum(hit) >= len(w)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, r["items"], r.contaminated) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


ITEMS = [(1, "One two three four's"), (2, "repeat me repeat me repeat me repeat me repeat me repeat me repeat me"), (3, None), (4, "!!"), (5, "école 漢字"), (None, "no id here"), (7, "word3 of3 word4 of4")]


@pytest.mark.parametrize("block", [4 << 20, 30])
@pytest.mark.parametrize("rows", [EDGE, []])
def test_against_brute_force(spark, rows, block, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
    items = clashing(spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert found(decontaminate.contamination(clashing(documents(spark, rows)), items)) == slow(rows, ITEMS)


def test_no_items(spark):
    items = spark.createDataFrame([], "item_id long, text string")
    assert not [r for r in found(decontaminate.contamination(documents(spark, EDGE), items)) if r[2]]


def test_table_and_sql(spark):
    got = queries.op7_decontaminate(spark, SF)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()["op7_decontaminate"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert any(r[-1] for r in want)


def test_proximity(spark):
    docs = documents(spark, [(1, "alpha x x beta"), (2, "beta x x x x x alpha"), (3, "alpha"), (4, "beta. Alpha beta")])
    got = decontaminate.proximity_matches(decontaminate.build_index(docs), [("q", "Alpha beta"), ("none", "gamma")], 3)
    assert {(r.doc_id, r.query) for r in got.collect()} == {(1, "q"), (4, "q")}


def test_clean_drops_contaminated_rows_alone(spark):
    docs, items = documents(spark, [(i, t) for i, t in EDGE if i is not None]), spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = {r[0] for r in slow([(i, t) for i, t in EDGE if i is not None], ITEMS) if r[4]}
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in EDGE if i is not None and i not in bad)


# The pipeline


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "decontamination", "bpe_encoding"]
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    assert sorted(q for q in entry.queries() if re.match(r"op\d", q)) == sorted(f.__name__ for f in queries.queries().values())


def test_pipeline_stage_by_stage(spark):
    """Each stage's rows follow from its input by a plain check; run() gives what the stages give."""
    docs = common.table(spark, SF, "documents")
    columns, now = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    model = toxicity.train(docs, common.table(spark, SF, "labels"))
    step = corpus_pipeline.drop_toxic(spark, docs, SF)
    toxic = {r.doc_id for r in toxicity.scores(docs, model).collect() if r.score >= 0.5}
    now = {i: t for i, t in now.items() if i not in toxic}
    assert step.columns == columns and {r.doc_id: r.text for r in step.collect()} == now
    step = corpus_pipeline.drop_near_duplicates(spark, step, SF)
    ids = sorted(now)
    fp = np.array([simhash.fingerprint(now[i]) for i in ids], np.uint64)
    near, label = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4, np.arange(len(ids))
    for _ in range(len(ids)):
        label = np.array([label[near[k]].min() for k in range(len(ids))])
    now = {ids[k]: now[ids[k]] for k in sorted(set(label.tolist()))}
    assert step.columns == columns and {r.doc_id: r.text for r in step.collect()} == now
    step = common.written(step, "test-step")
    spans = {}
    for r in substring.passages(step).collect():
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
    cut = {i: substring.cut(t, spans[i]) if i in spans else (t, False) for i, t in now.items()}
    step = common.written(corpus_pipeline.cut_repeated_passages(spark, step, SF), "test-step")
    now = {i: t for i, (t, gone) in cut.items() if not gone}
    assert step.columns == columns and {r.doc_id: r.text for r in step.collect()} == now
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    bad = {r[0] for r in slow(now.items(), items) if r[4]}
    step = corpus_pipeline.drop_contaminated(spark, step, SF)
    now = {i: t for i, t in now.items() if i not in bad}
    assert step.columns == columns and {r.doc_id: r.text for r in step.collect()} == now
    last = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.encode(spark, step, SF).collect()}
    assert last == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in now.items()}
    assert {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, SF).collect()} == last


@pytest.mark.parametrize("stage", range(5))
def test_stages_bear_odd_documents(spark, stage):
    docs = clashing(documents(spark, EDGE))
    _, f = corpus_pipeline.STAGES[stage]
    out = f(spark, docs, SF)
    assert stage == 4 or out.columns == docs.columns
    assert out.count() > 5
    assert f(spark, docs.limit(0), SF).count() == 0


def test_vocabularies_are_where_the_package_says():
    assert all(P.path(n) for n in (queries.BYTE_BPE, queries.WORD_BPE))
