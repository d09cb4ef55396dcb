import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkwarden.llm import common, components, simhash, substring, wordhash

from .helpers import EDGE, LONG, SF, clashing, documents


def ascii_lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def split(t):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", ascii_lower(t)) if w]


# SimHash


def slow_print(t):
    w = split(t)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    """(id, print) -> smallest reachable non-null id, by comparing all pairs."""
    fp = np.array([p for _, p in prints], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 4
    label = np.arange(len(fp))
    while True:
        new = np.array([label[near[k]].min() for k in range(len(fp))])
        if (new == label).all():
            break
        label = new
    least = defaultdict(list)
    for (i, _), k in zip(prints, label, strict=True):
        least[k] += [i] * (i is not None)
    return [(i, f"{p:016x}", min(least[k], default=None)) for (i, p), k in zip(prints, label, strict=True)]


def test_fingerprint_by_hand():
    texts = [t for _, t in EDGE if t != LONG] + ["a b", "A  b\tc D", "a b c d e", "É é x y z"]
    assert [simhash.fingerprint(t) for t in texts] == [slow_print(t) for t in texts]


def some(x):
    return [tuple("" if y is None else str(y) for y in r) for r in x]


@pytest.mark.parametrize("rows", [[r for r in EDGE if r[1] != LONG], [], None])
def test_components_of_documents(spark, rows):
    docs = common.table(spark, SF, "documents") if rows is None else clashing(documents(spark, rows))
    rows = [(r.doc_id, r.text) for r in docs.collect()] if rows is None else rows
    got = simhash.near_duplicates(docs)
    assert sorted(some(map(tuple, got.collect()))) == sorted(some(slow_components([(i, slow_print(t)) for i, t in rows])) if rows else [])


def near_prints(seed, n, chains):
    r = np.random.default_rng(seed)
    out = r.integers(0, 2**63, n).astype(np.uint64).tolist() + [0, 1, (1 << 64) - 1]
    for x in out[:chains]:
        for _ in range(6):  # chains whose ends are far apart
            for b in r.integers(0, 64, int(r.integers(1, 7))).tolist():
                x ^= 1 << b
            out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize("tile", [64, 1024])
def test_tiles_miss_no_link(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash, "SMALL", 16)
    monkeypatch.setattr(simhash, "LEAST_TILES", 1)
    monkeypatch.setattr(simhash, "max", lambda a, b: b if a == 1024 else max(a, b), raising=False)
    prints = near_prints(1, 700, 60)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {r.u: r.v for r in components.components(simhash.links(df, tile=tile)).collect()}
    want = slow_components([(x, p) for x, p in zip(signed, prints, strict=True)])
    assert [root.get(x, x) for x in signed] == [c for _, _, c in want]


def test_forest_between_two_tiles():
    prints = np.array(near_prints(2, 300, 40), np.uint64)
    a, b = prints[::2].copy(), prints[1::2].copy()
    u, v = simhash.forest_of(a, b, 4)
    assert len(u) < len(prints)
    bits = np.bitwise_count(a[:, None] ^ b[None, :]) <= 4
    tied = dict(zip(u.tolist(), v.tolist(), strict=True))
    for i, j in zip(*np.nonzero(bits), strict=True):
        x, y = (int(np.int64(z.view(np.int64))) for z in (a[i : i + 1][0], b[j : j + 1][0]))
        assert tied.get(x, x) == tied.get(y, y)


def test_long_paths(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(200)] + [(1000, 500), (1001, 1000)], "u long, v long")
    got = {r.u: r.v for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000: 500, 1001: 500}


@pytest.mark.parametrize("task_edges", [0, 1 << 20])
def test_few_edges_take_one_task(spark, monkeypatch, task_edges):
    """The same components either way; a small table isn't written round after round."""
    r = random.Random(8)
    pairs = [(i + 1, i) for i in range(60)] + [tuple(sorted(r.sample(range(-500, 500), 2), reverse=True)) for _ in range(300)]
    label = {x: x for p in pairs for x in p}
    while any(label[u] != label[v] for u, v in pairs):
        for u, v in pairs:
            label[u] = label[v] = min(label[u], label[v])
    written, kept = [], common.written
    monkeypatch.setattr(common, "written", lambda df, name: written.append(name) or kept(df, name))
    monkeypatch.setattr(components, "TASK_EDGES", task_edges, raising=False)
    got = {r.u: r.v for r in components.components(spark.createDataFrame(pairs + pairs, "u long, v long")).collect()}
    assert got == {x: y for x, y in label.items() if x != y}
    assert len(written) == 2 or task_edges == 0


def test_one_of_each_group_stays(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(3, base), (1, base), (2, base + " end"), (9, "quite another text of some words"), (9, "quite another text of some words"), (None, "nameless text")]
    docs = clashing(documents(spark, rows))
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 9]


REPEATS = [(3, "b"), (9, "a"), (9, "b"), (None, "c"), (None, "c"), (None, "d"), (None, "b"), (7, "e"), (7, "e"), (5, "f"), (6, "f")]


@pytest.mark.parametrize("extra", [[], [(7, "e")]])
def test_rows_that_share_an_id_are_told_by_text(spark, extra):
    """What stays doesn't depend on whether some other id is repeated."""
    words = lambda x: " ".join(f"{x}{i * i % 97}x{i}" for i in range(120))
    rows = [(i, words(t)) for i, t in REPEATS + extra]
    kept = simhash.deduplicate(clashing(documents(spark, rows)))
    assert sorted((str(r.doc_id), r.text[0]) for r in kept.collect()) == [("3", "b"), ("5", "f"), ("7", "e"), ("9", "a"), ("None", "c"), ("None", "d")]


def test_hot_fingerprints_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_ROWS", 3)
    rows = [(i, "") for i in range(20)] + [(100 + i, f"text number {i} of some words") for i in range(5)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, rows)).collect()}
    assert got == {i: 0 for i in range(20)} | {100 + i: 100 + i for i in range(5)}


# Substrings


def slow_windows(h, width):
    """Nodes (l, c, r) of the Cartesian tree, by recursion; no ties in h."""
    out, todo = [], [(0, len(h) - 1)]
    while todo:
        lo, hi = todo.pop()
        if hi - lo + 1 >= width:
            c = lo + int(np.argmin(h[lo : hi + 1]))
            out.append((lo, c, hi))
            todo += [(lo, c - 1), (c + 1, hi)]
    return sorted(out)


@pytest.mark.parametrize("n, width", [(1, 1), (5, 3), (300, 7), (3000, 46), (40, 46)])
def test_compact_windows(n, width):
    h = np.random.default_rng(n).integers(1 << 30, 1 << 62, n).astype(np.uint64)
    begin, end = (np.array(x) for x in ([0], [n]))
    keep = end - begin >= width
    _, lo, c, hi = substring.compact_windows(h, begin[keep], end[keep], width)
    assert sorted(zip(lo.tolist(), c.tolist(), hi.tolist(), strict=True)) == slow_windows(h >> np.uint64(24), width)


def test_windows_of_equal_tokens_cover_everything():
    _, lo, c, hi = substring.compact_windows(np.full(5000, 7 << 40, np.uint64), np.array([0]), np.array([5000]), 46)
    assert lo.min() == 0 and hi.max() == 4999 and ((lo <= c) & (c <= hi)).all()


def test_long_texts_are_cut_with_overlap(monkeypatch):
    monkeypatch.setattr(substring, "SPAN", 200)
    text, begin, end = substring._segments(np.array([0, 1000, 1003, 1100]), 46)
    assert set(text.tolist()) == {0, 2}
    covered = {(s, s + 46) for b, e in zip(begin, end, strict=True) for s in range(b, e - 45)}
    assert {(s, s + 46) for s in range(0, 996 - 45)} <= covered


def slow_cover(rows, n=50):
    """Words in runs of n that an earlier document (smaller id) has too."""
    first, cover = {}, defaultdict(set)
    for i, t in sorted(rows):
        w = split(t)
        for k in range(len(w) - n + 1):
            f = first.setdefault(tuple(w[k : k + n]), i)
            if f < i:
                cover[i].update(range(k, k + n))
    return cover


def covered(got):
    out = defaultdict(set)
    for r in got:
        out[r.doc_id].update(range(r.start, r.end))
    return out


def shingles(w):
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.fixture(scope="module")
def planted():
    r = random.Random(5)
    vocab = [f"v{i}" for i in range(4000)]
    words = lambda n: [r.choice(vocab) for _ in range(n)]
    shared, other, line = words(70), words(51), words(12)
    rows = [(100 + i, words(r.randint(60, 300))) for i in range(40)]
    for i in range(0, 12):
        at = r.randint(0, len(rows[i][1]))
        rows[i][1][at:at] = shared
    for i in range(8, 16):
        rows[i][1].extend(other)
    for i in range(0, 40):
        rows[i][1].extend(line)  # short of a passage
    for i in (20, 21):  # near copies: one word of 90 changed, one dropped
        body = words(90)
        rows[i][1].extend(body)
        changed = body[:30] + ["new"] + body[31:]
        rows[i + 10][1].extend(changed if i == 20 else body[:45] + body[46:])
    return [(i, " ".join(w)) for i, w in rows]


def test_planted_passages(spark, planted):
    got = substring.passages(clashing(documents(spark, planted))).collect()
    want, have = slow_cover(planted), covered(got)
    assert all(want[i] <= have[i] for i in want)
    assert {r.doc_id for r in got} == {101 + i for i in range(11)} | {109 + i for i in range(7)} | {130, 131}
    text = {i: split(t) for i, t in planted}
    for r in got:
        a, b = text[r.doc_id][r.start : r.end], text[r.source_doc_id][r.source_start : r.source_end]
        assert r.source_doc_id < r.doc_id and min(len(a), len(b)) >= 50
        x, y = shingles(a), shingles(b)
        assert r.similarity == pytest.approx(len(x & y) / len(x | y)) and r.similarity >= 0.8


def test_documents_table(spark):
    docs = common.table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, have = slow_cover(rows), covered(substring.passages(docs).collect())
    missed = sum(len(want[i] - have[i]) for i in want)
    assert not [i for i in want if i not in have] and missed <= 0.01 * sum(map(len, want.values()))


def test_remove_keeps_first_places(spark, planted):
    docs = clashing(documents(spark, planted))
    left = substring.remove(docs)
    assert left.columns == docs.columns
    after = {r.doc_id: r for r in left.collect()}
    rows = [(i, r.text) for i, r in after.items()]
    assert len(after) == len(planted) and not slow_cover(rows)
    assert all(r.n_chars == len(r.text) for r in after.values())
    all_before = {s for _, t in planted for s in zip(*[split(t)[k:] for k in range(50)], strict=False)}
    all_after = {s for _, t in rows for s in zip(*[split(t)[k:] for k in range(50)], strict=False)}
    shared = {s for s in all_before if sum(" ".join(s) in ascii_lower(t) for _, t in planted) > 1}
    assert shared <= all_after  # nothing is gone from everywhere


def test_whole_copies_go(spark):
    body = " ".join(f"w{i}" for i in range(80))
    docs = documents(spark, [(1, body), (2, body), (3, f"intro {body}\n\nend of it"), (4, "short"), (5, None)])
    got = {r.doc_id: r.text for r in substring.remove(docs).collect()}
    assert got == {1: body, 3: "intro end of it", 4: "short", 5: None}


def test_passages_of_rows_that_share_an_id(spark):
    body, other = (" ".join(f"{x}{i}" for i in range(80)) for x in "uv")
    rows = [(1, body), (2, body), (2, "a short text"), (2, other), (None, other + " and more"), (None, "x " + body), (None, "nothing"), (5, other + " to the end"), (5, other + " to the end")]
    docs = clashing(documents(spark, rows))
    got = {(r.doc_id, r.source_doc_id, r.end - r.start) for r in substring.passages(docs).collect()}
    assert got - {(2, 1, 80)} == {(1, None, 80), (2, None, 80), (5, None, 80)}
    left = sorted((str(r.doc_id), r.text) for r in substring.remove(docs).collect())
    assert left == sorted([("2", "a short text"), ("None", other + " and more"), ("None", "x " + body), ("None", "nothing"), ("5", "to the end"), ("5", "to the end")])


def test_an_earlier_row_with_very_many_pairs(spark, monkeypatch):
    monkeypatch.setattr(substring, "HOT_PAIRS", 4)
    body = " ".join(f"h{i}" for i in range(60))
    rows = [(i, f"{' '.join(f'q{i}x{k}' for k in range(20))} {body}") for i in range(40)]
    got = substring.passages(documents(spark, rows)).collect()
    assert {(r.doc_id, r.start, r.end) for r in got if r.source_doc_id == 0} == {(i, 20, 80) for i in range(1, 40)}
    assert all(r.source_doc_id < r.doc_id and (r.start, r.end) == (20, 80) for r in got)


def test_copies_are_looked_up_by_document(spark):
    """What the documents of a slice have of its first one is a row or two each, not one a window; no place of it is lost."""
    body = [f"k{i}" for i in range(600)]
    rows = [(i, " ".join([f"p{i}x{k}" for k in range(30 + i)] + body)) for i in range(40)]
    docs = documents(spark, rows).coalesce(1)
    keyed = common.key_text(docs, "doc_id", "text").withColumn("text_key", common.content_key(F.col("text")))
    pairs = substring._links(keyed, substring.CONTEXTS)[0].filter("rep_doc = 0").collect()
    assert {r.doc_id for r in pairs} == set(range(1, 40)) and len(pairs) <= 4 * 39
    assert all((x >> 32) - (x & 0xFFFFFFFF) == r.doc_id for r in pairs for x in r.anchors or [r.anchor])
    assert {(g.doc_id, g.source_doc_id, g.start, g.end) for g in substring.passages(docs).collect()} == {(i, 0, 30 + i, 630 + i) for i in range(1, 40)}


def edited(r, words, n, edits, kinds):
    """Two versions of a passage of n words, with as many edits, spread at random."""
    p = [r.choice(words) for _ in range(n)]
    q = list(p)
    for at in sorted(r.sample(range(n), edits), reverse=True):
        kind = r.choice(kinds)
        q[at : at + 1] = [] if kind == "delete" else [r.choice(words)] + [q[at]] * (kind == "insert")
    return p, q


@pytest.mark.parametrize("n, edits", [(60, 1), (100, 2), (200, 3), (200, 4), (400, 8)])
def test_recall_of_whole_near_duplicate_passages(spark, n, edits):
    """Passages with Jaccard of 0.8 or more, in documents of their own; whole: all but the few words beyond the last edit at either end."""
    r = random.Random(n * 10 + edits)
    vocab = [f"v{i}" for i in range(5000)]
    rows, want = [], {}
    while len(want) < 150:
        p, q = edited(r, vocab, n, edits, ("change", "change", "insert", "delete"))
        x, y = shingles(p), shingles(q)
        if len(x & y) < 0.8 * len(x | y):
            continue
        k = len(want)
        before, after = (r.randint(5, 120) for _ in range(2))
        fresh = lambda m: [r.choice(vocab) for _ in range(m)]
        rows += [(k, " ".join(fresh(after) + p + fresh(before))), (1000 + k, " ".join(fresh(before) + q + fresh(after)))]
        want[1000 + k] = (before, before + len(q))
    got = defaultdict(list)
    for g in substring.passages(documents(spark, rows)).collect():
        got[g.doc_id].append((g.start, g.end))
    whole = sum(any(s <= lo + 5 and e >= hi - 5 for s, e in got[i]) for i, (lo, hi) in want.items())
    inside = sum(all(s >= lo - 3 and e <= hi + 3 for s, e in got[i]) for i, (lo, hi) in want.items())
    some = sum(bool(got[i]) for i in want)
    print(n, edits, "whole", whole, "some", some, "inside", inside)
    assert whole >= 0.9 * len(want) and inside >= 0.97 * len(want)


@pytest.mark.parametrize("rows", [EDGE, [], [(i, "") for i in range(3)]])
def test_odd_documents(spark, rows):
    docs = clashing(documents(spark, rows))
    got = substring.passages(docs).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} <= {(7, 6)}
    assert substring.remove(docs).count() >= len(rows) - 2


def test_cut_is_by_words():
    assert substring.cut("  a bé\n c  d ", [(1, 3)]) == ("  a d ", False)
    assert substring.cut("x y", [(0, 2)]) == ("", True)


def test_word_hashes_are_of_words():
    w = wordhash.words(pa.array(["ab cd", None, "ab", "x" * 3_000_000, "cd"]), wordhash.NOT_SPACE)
    h = w.hashes()
    assert w.first.tolist() == [0, 2, 2, 3, 4, 5] and h[0] == h[2] and h[1] == h[4] and len(set(h.tolist())) == 3


def test_repetitive_tokens_stand_for_their_beginning():
    token, text = np.array([5, 1, 1, 2, 1, 9, 9, 9, 9, 1], np.uint64), np.array([0] * 9 + [1])
    assert substring._cluster_starts(token, text, 3).tolist() == [0, 1, 1, 3, 1, 5, 5, 5, 5, 9]


def test_runs_of_one_word(spark):
    r = random.Random(4)
    words = lambda n: " ".join(f"u{r.randint(0, 10**6)}" for _ in range(n))
    rows = [(1, f"{words(60)} {'of ' * 9} {words(60)}"), (2, f"{words(50)} {'of ' * 58} {words(40)}"), (3, f"{words(70)} {'of ' * 46} {words(5)}"), (4, f"{words(9)} {'of ' * 700} {words(80)}")]
    got = substring.passages(documents(spark, rows)).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} == {(4, 2)}


@pytest.mark.parametrize("rows_a_batch", [1, 3, 10_000])
@pytest.mark.parametrize("slice_bytes", [500, 2 << 20])
def test_neighbours_that_share_more_than_with_the_first(spark, monkeypatch, rows_a_batch, slice_bytes):
    """B and C share a passage of which A has only the first words; all cuts into slices and batches find it."""
    r = random.Random(9)
    words = lambda n: [f"z{r.randint(0, 10**6)}" for _ in range(n)]
    passage = words(60)
    rows = [(1, " ".join(words(80) + passage[:30] + words(80)))]
    rows += [(i, " ".join(words(70) + passage + words(i))) for i in (2, 3, 4)]
    slices = common.slices
    monkeypatch.setattr(common, "SLICE_BYTES", slice_bytes)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
    try:
        got = substring.passages(documents(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert common.slices is slices and {r.doc_id for r in got} == {3, 4}
    assert all(r.similarity == 1.0 and r.end - r.start >= 60 for r in got)


@pytest.mark.parametrize("parts, width", [(1, 45), (20, 38), (20, 48)])
def test_earlier_parts_do_not_hide_a_later_pair(spark, parts, width):
    """The words at each place of a passage are in earlier documents too, one or many, none of which has all of it."""
    r = random.Random(parts)
    words = lambda n: [f"x{r.randint(0, 10**6)}" for _ in range(n)]
    passage = words(60)
    rows = [(i, " ".join(words(60) + passage[:width] + words(60) + passage[-width:] + words(60))) for i in range(parts)]
    rows += [(100 + i, " ".join(words(70) + passage + words(80))) for i in range(3)]
    got = {(g.doc_id, g.source_doc_id, g.start, g.end) for g in substring.passages(documents(spark, rows)).collect()}
    assert {(101, 100, 70, 130), (102, 100, 70, 130)} == {g for g in got if g[0] >= 100}


def test_no_edited_passage_is_left_to_chance(spark):
    r = random.Random(3)
    vocab = [f"v{i}" for i in range(5000)]
    rows, k = [], 0
    while k < 1000:
        n = r.randint(51, 120)
        p, q = edited(r, vocab, n, max(1, n // 50), ("change", "insert", "delete"))
        x, y = shingles(p), shingles(q)
        if min(len(p), len(q)) < 50 or p[:3] != q[:3] or p[-3:] != q[-3:] or len(x & y) < 0.8 * len(x | y):
            continue
        rows += [(k, " ".join([f"a{k}x{i}" for i in range(60)] + p)), (1000 + k, " ".join(q + [f"b{k}x{i}" for i in range(60)]))]
        k += 1
    assert {g.doc_id for g in substring.passages(documents(spark, rows)).collect()} == set(range(1000, 2000))


@pytest.mark.parametrize("partitions", [1, 2])
def test_both_copies_of_a_passage_in_one_document(spark, partitions):
    """However rows fall into slices, a later document loses each of its copies."""
    r = random.Random(11)
    words = lambda n: [f"y{r.randint(0, 10**6)}" for _ in range(n)]
    passage = words(60)
    rows = [(1, " ".join(words(80) + passage + words(40))), (2, " ".join(words(70) + passage + words(90) + passage + words(50)))]
    docs = documents(spark, rows).repartitionByRange(partitions, "doc_id")
    have = covered(substring.passages(docs).collect())
    assert have[2] >= {*range(70, 130), *range(220, 280)} and 1 not in have


def anchor(k, c, rep_c, lo, hi):
    return k, c, rep_c, int(substring._reach(np.int64(c), np.int64(lo), np.int64(hi)))


def test_edited_passage_between_repeated_lines():
    """Every repeat of a line begins a chain on each anchor's diagonal; those don't come between the halves of a passage."""
    r = np.random.default_rng(3)
    fresh = lambda n: r.integers(1000, 1 << 30, n).astype(np.uint32)
    line = fresh(20)
    found = 0
    for _ in range(50):
        a, b = (np.concatenate([x for _ in range(14) for x in (line, fresh(50))]) for _ in range(2))
        at_a, at_b = 70 * 6 - 21, 70 * 9 - 21
        passage = np.concatenate([fresh(21), line, fresh(21)])
        a[at_a : at_a + 62] = b[at_b : at_b + 62] = passage
        a[at_a + 31] = 999  # one word of the line
        anchors = [anchor(k, at_a + p, at_b + p, at_a, at_a + 61) for k, p in enumerate((3, 45))]
        anchors += [anchor(k % 4, 70 * x + 5, 5, 70 * x, 70 * x + 60) for k, x in enumerate(range(1, 14))] + [anchor(k % 4, 5, 70 * x + 5, 0, 60) for k, x in enumerate(range(1, 14))]
        found += any(i0 <= at_a and i1 >= at_a + 62 and j0 <= at_b and j1 >= at_b + 62 for i0, i1, j0, j1, _ in substring.verified(a, b, anchors))
    assert found == 50


@pytest.mark.parametrize("at", [10, 27, 44])
@pytest.mark.parametrize("side", [0, 1])
@pytest.mark.parametrize("edit", ["insert", "delete"])
def test_one_edit_with_anchors_on_one_side(edit, side, at):
    r = np.random.default_rng(at)
    fresh = lambda n: r.integers(1000, 1 << 30, n).astype(np.uint32)
    p = fresh(54)
    q = np.concatenate([p[:at], fresh(1), p[at:]]) if edit == "insert" else np.concatenate([p[:at], p[at + 1 :]])
    a, b = np.concatenate([fresh(80), q, fresh(60)]), np.concatenate([fresh(30), p, fresh(90)])
    anchors = [anchor(k, 80 + 2, 30 + 2, 80, 80 + len(q)) if side == 0 else anchor(k, 80 + len(q) - 6, 30 + 48, 80, 80 + len(q)) for k in (0, 1)]
    assert [x[:4] for x in substring.verified(a, b, anchors)] == [(80, 80 + len(q), 30, 84)]
