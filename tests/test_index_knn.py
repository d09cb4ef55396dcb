from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwarden.functions.scalar import SLOTS
from sparkwarden.operators import index, knn
from sparkwarden.plans import index_store

N, Q = 600, 25


def rows_of(n, seed, missing=True):
    rng = np.random.default_rng(seed)
    x = np.round(rng.random((n, 14)), 2).astype(np.float32)  # coarse, so that distances tie
    if missing:
        x[rng.random(n) < 0.2, 1] = -1
    return x


@pytest.fixture(scope="module")
def refs(spark):
    from sparkwarden.functions import scalar

    x = rows_of(N, 1)
    x[50:90] = x[50]  # copies
    data = [(i, int(i % 3 == 0), *map(float, v)) for i, v in enumerate(x)]
    df = spark.createDataFrame(data, "ref_id long, label int, " + ", ".join(f"{s} float" for s in SLOTS))
    return df.select("ref_id", "label", *[scalar.quantize(F.col(s)).alias(s) for s in SLOTS]).cache()


@pytest.fixture(scope="module")
def queries(spark):
    data = [(i, *map(float, v)) for i, v in enumerate(np.vstack([rows_of(Q - 1, 2), rows_of(N, 1)[50:51]]))]
    return spark.createDataFrame(data, "qid long, " + ", ".join(f"{s} float" for s in SLOTS)).cache()


@pytest.fixture(scope="module")
def built(refs):
    return index_store.build(refs, nlist=12, block=16, sample=300, iterations=3)


def brute(queries, refs):
    step = np.float32(1) / np.float32(65534)
    r = np.array([[row[s] for s in SLOTS] for row in refs.orderBy("ref_id").collect()])
    r = np.where(r == 65535, np.float32(-1), r.astype(np.float32) * step)
    out = set()
    for row in queries.collect():
        d = np.zeros(len(r), np.float32)
        for i, s in enumerate(SLOTS):
            gap = np.float32(row[s]) - r[:, i]
            d += gap * gap
        for rank, k in enumerate(np.lexsort([np.arange(len(r)), d])[:5]):
            out.add((row.qid, rank + 1, int(k), float(d[k])))
    return out


def found(df):
    return {(r.qid, r["rank"], r.ref_id, r.d) for r in df.collect()}


def test_three_ways_agree_with_brute_force(queries, refs, built):
    want = brute(queries, refs)
    assert found(knn.exact(queries, refs)) == want
    assert found(knn.kernel(queries, refs)) == want
    assert found(knn.kernel(queries, refs, block=7)) == want
    assert found(knn.ivf(queries, built, nprobe=2)) == want
    assert found(knn.ivf(queries, built, nprobe=5, adaptive=True)) == want


def test_fewer_references_than_places(queries, refs):
    few = refs.filter("ref_id < 3")
    counts = knn.fraud_counts(knn.kernel(queries, few), queries).collect()
    assert len(counts) == Q and all(r.fraud_count == 1 for r in counts)
    none = knn.fraud_counts(knn.kernel(queries, refs.limit(0)), queries).collect()
    assert all(r.fraud_count == 0 for r in none)


def test_no_queries(queries, refs):
    assert knn.kernel(queries.limit(0), refs).count() == 0


def test_lists_and_blocks(refs, built):
    vectors = built.vectors.collect()
    assert len(vectors) == N and len({v.ref_id for v in vectors}) == N
    by_list = {}
    for v in vectors:
        by_list.setdefault(v.list_id, []).append(v)
    stats = {r.list_id: r for r in built.lists.collect()}
    blocks = {(r.list_id, r.block_id): r for r in built.blocks.collect()}
    for k, members in by_list.items():
        members.sort(key=lambda v: v.place)
        assert [v.place for v in members] == list(range(len(members)))
        assert [(v.radius, v.ref_id) for v in members] == sorted((v.radius, v.ref_id) for v in members)
        assert stats[k].n == len(members) and stats[k].radius == members[-1].radius and stats[k].blocks == -(-len(members) // 16)
        for v in members:
            assert v.block_id == v.place // 16
            assert blocks[k, v.block_id].min_radius <= v.radius <= blocks[k, v.block_id].max_radius
    offsets = index.list_offsets(built.lists).orderBy("list_id").collect()
    assert [o["first"] for o in offsets] == [sum(stats[p.list_id].n for p in offsets[:i]) for i in range(len(offsets))]


def test_profile(queries, built):
    for r in knn.prune_profile(queries, built, nprobe=2).collect():
        assert r.lists_probed == 2 and r.lists_considered == 10 and r.lists_candidate + r.lists_pruned == 10 and r.vectors_probed + r.vectors_candidate <= N


def test_write_and_open(spark, built, queries, refs, tmp_path):
    path = str(tmp_path / "index")
    assert not index_store.ready(spark, path)
    index_store.write(built, path, 3)
    assert index_store.ready(spark, path)
    assert found(knn.ivf(queries, index_store.open_index(spark, path), nprobe=3)) == brute(queries, refs)
    built.meta.withColumn("dim", F.lit(13)).write.mode("overwrite").parquet(f"{path}/meta")
    with pytest.raises(ValueError, match="dimension 13"):
        index_store.open_index(spark, path)


def test_sample_is_exact_and_repeatable(refs):
    a, b = ({r.ref_id for r in index.sample_exact(refs.repartition(k), 100).collect()} for k in (1, 3))
    assert len(a) == 100 and a == b
    assert index.sample_exact(refs, 10_000).count() == N


def test_empty_lists_are_reseeded(spark):
    x = [(i, *[float(i % 2)] * 14) for i in range(20)]  # two places only, five lists
    points = spark.createDataFrame(x, "ref_id long, " + ", ".join(f"{s} float" for s in SLOTS))
    assert index.kmeans(points, 5, 2).count() == 5
    with pytest.raises(ValueError):
        index.kmeans(points, 21, 1)


def test_exact_refuses_many_queries(spark, refs, queries, monkeypatch):
    monkeypatch.setattr(knn, "EXACT_QUERIES", 10)
    with pytest.raises(ValueError):
        knn.exact(queries, refs)


def test_phase_timings(queries, built):
    got = {r.phase: r.seconds for r in knn.phase_timings(queries, built, nprobe=2).collect()}
    assert got.keys() == {"plan", "probe", "build", "scan", "total"} and all(x > 0 for x in got.values()) and got["total"] >= got["probe"] + got["scan"]


def test_closing_frees_an_index(spark, refs):
    made = index_store.build(refs, nlist=4, block=16, sample=100, iterations=1)
    assert index_store.ready(spark, made.path)
    made.close()
    assert not index_store.ready(spark, made.path)


@pytest.mark.parametrize("limited", [False, True])
def test_bounded_distances_lose_nothing(limited):
    """More queries and references than a tile, in uneven batches, with ties, against every distance."""
    q, r = rows_of(700, 3), rows_of(9000, 4)
    r[4000:4300] = q[7]  # ties over a tile's end
    ids = np.random.default_rng(5).permutation(len(r)).astype(np.int64)
    limit = np.full(len(q), 0.4, np.float32) if limited else None
    best = knn._Best(q, 5, limit)
    for begin, end in [(0, 3), (3, 5000), (5000, 5000), (5000, 9000)]:
        best.add(r[begin:end], ids[begin:end], ids[begin:end].astype(np.int32) % 2)
    got = list(zip(*(c.to_pylist() for c in best.found(np.arange(len(q)))), strict=True))
    want = []
    for i, x in enumerate(q):
        d = np.zeros(len(r), np.float32)
        for s in range(14):
            gap = x[s] - r[:, s]
            d += gap * gap
        first = [k for k in np.lexsort([ids, d])[:5] if limit is None or d[k] <= limit[i]]
        want += [(i, int(ids[k]), int(ids[k]) % 2, float(d[k])) for k in first]
    assert got == want


def test_bounded_distances_skip_missing_slots():
    q, r = rows_of(3, 6), rows_of(40, 7)
    q[1, 4] = np.nan
    best = knn._Best(q, 5)
    best.add(r, np.arange(40), np.zeros(40, np.int32))
    assert set(best.found(np.arange(3))[0].to_pylist()) == {0, 2}


def test_a_list_is_laid_out_over_several_ranges(spark, monkeypatch):
    rng = np.random.default_rng(5)
    data = [(i, int(k), float(r)) for i, (k, r) in enumerate(zip(rng.choice([1, 2, 2, 2, 2, 7], 500), rng.integers(0, 40, 500) / 8, strict=True))]
    rows = spark.createDataFrame(data, "ref_id long, list_id int, radius float")
    tables, keep = [], index.kept
    monkeypatch.setattr(index, "kept", lambda df, name: tables.append(keep(df, name)) or tables[-1])
    was = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        laid_out = index.layout(rows, 16)
        assert tables[0].filter("list_id = 2").select("__part").distinct().count() > 1
        got = {r.ref_id: (r.list_id, r.place, r.block_id) for r in laid_out.collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    want = {}
    for key in {k for _, k, _ in data}:
        members = sorted((r, i) for i, k, r in data if k == key)
        want |= {i: (key, place, place // 16) for place, (_, i) in enumerate(members)}
    assert got == want
    assert index.layout(rows.limit(0), 16).collect() == []


@pytest.mark.parametrize("block", [1 << 23, 40])
def test_neighbours_of_vectors_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "ARRAY_BLOCK", block)
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(size=(90, 6)), 1).astype(np.float32)  # coarse, so that distances tie
    x[20:30] = x[20]
    vectors = [[float(a) for a in v] for v in x]
    rows = [*enumerate(vectors), (90, None), (None, vectors[0]), (91, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (92, [float("nan")] * 6), (93, [0.5, 0.5]), (94, [0.5, 0.7]), (95, []), (3, vectors[4])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.q_id, r["rank"], r.r_id, r.d) for r in knn.array_neighbours(table.filter("vec_id % 5 = 0 or vec_id in (91, 93)"), table).collect()}
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and None not in v and not np.isnan(v).any()]
    want = set()
    for i, v in sound:
        if i % 5 == 0 or i == 93:
            # added one by one, as sum() of Python compensates
            near = sorted((reduce(lambda d, gap: d + gap * gap, (v - w).tolist(), 0.0), j) for j, w in sound if len(w) == len(v) and j != i)
            want |= {(i, rank, j, d) for rank, (d, j) in enumerate(near[:5], 1)}
    assert got == want
    assert knn.array_neighbours(table.limit(0), table).collect() == [] and knn.array_neighbours(table, table.limit(0)).collect() == []


def test_join_in_parts(queries, refs, monkeypatch):
    """Parts of both sides, and more queries than one broadcast takes, give what the kernel gives."""
    monkeypatch.setattr(knn, "EXACT_QUERIES", 10)
    monkeypatch.setattr(knn, "JOIN_PARTS", (7, 100))
    assert found(knn.joined(queries, refs)) == found(knn.kernel(queries, refs))


def test_join_leaves_out_parts_that_are_too_far(spark, monkeypatch):
    """Most pairs of query and reference never meet, though copies, missing values and all lone vectors are found."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps

    from sparkwarden.functions import scalar

    rng = np.random.default_rng(5)
    x = np.clip(np.round(rng.integers(0, 5, (3000, 1)) / 5 + rng.random((3000, 14)) / 20, 3), 0, 1).astype(np.float32)
    x[rng.random(3000) < 0.1, 1] = -1
    x[100:400] = x[100]  # more copies than a part or a box has
    x[7] = np.where(np.arange(14) % 2, 1, 0)  # far from all others
    slots = ", ".join(f"{s} float" for s in SLOTS)
    rows = spark.createDataFrame([(i, i % 2, *map(float, v)) for i, v in enumerate(x)], f"ref_id long, label int, {slots}")
    refs = rows.select("ref_id", "label", *[scalar.quantize(F.col(s)).alias(s) for s in SLOTS]).cache()
    queries = rows.filter("ref_id % 7 = 0").drop("label").withColumnRenamed("ref_id", "qid")
    queries = queries.union(queries.limit(1).select(F.lit(-1).alias("qid"), F.lit(None).cast("float"), *SLOTS[1:])).cache()
    met, whole = spark.sparkContext.accumulator(0), PandasCogroupedOps.applyInArrow

    def counting(self, scan, schema):
        def counted(asked, given):
            met.add(asked.num_rows * given.num_rows)
            return scan(asked, given)

        return whole(self, counted, schema)

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", counting)
    monkeypatch.setattr(knn, "JOIN_PARTS", (50, 200))
    got = found(knn.joined(queries, refs))
    monkeypatch.undo()
    assert got == brute(queries.filter("qid >= 0"), refs) and {r[0] for r in got} >= {7, 105}
    assert 0 < met.value < queries.count() * 3000 / 3


def test_near_references_by_boxes():
    """Boxes leave out what bounds rule out, and nothing else: against every distance, for uniform, coarse, equal and far vectors."""
    rng = np.random.default_rng(6)
    for refs, asked in (
        (rng.random((5000, 14)), rng.random((300, 14))),
        (rng.integers(0, 3, (5000, 14)) / 2, rng.integers(0, 3, (200, 14)) / 2),
        (np.ones((2000, 14)) / 3, np.ones((100, 14)) / 3),
        (np.vstack([rng.random((1500, 14)) / 100, np.ones((700, 14)), rng.random((4, 14))]), rng.random((90, 14))),
        (rng.random((3, 14)), rng.random((9, 14))),
    ):
        refs, asked, ids = refs.astype(np.float32), asked.astype(np.float32), rng.permutation(len(refs)).astype(np.int64)
        d = np.zeros((len(asked), len(refs)), np.float32)
        for i in range(14):
            gap = asked[:, None, i] - refs[None, :, i]
            d += gap * gap
        for limit in (None, np.sort(d, 1)[:, min(4, len(refs) - 1)]):
            best = knn._Best(asked, 5, limit)
            best.add_near(refs, ids, np.zeros(len(refs), np.int32))
            for q in range(len(asked)):
                want = np.lexsort([ids, d[q]])[:5]
                assert best.ref[q, : len(want)].tolist() == ids[want].tolist() and best.d[q, : len(want)].tolist() == d[q, want].tolist()
