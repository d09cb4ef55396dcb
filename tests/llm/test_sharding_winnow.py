import hashlib
import zlib
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from sparkwarden.llm import common, sharding, winnow

from .helpers import EDGE, SF, clashing, documents


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def in_groups(rows):
    """Rows in the order that shards follow, by a plain sort; a group's key instead of its hash."""
    first = {}
    for i, t in rows:
        first[t or ""] = min(first.get(t or "", i or -1), -1 if i is None else i)
    return sorted(rows, key=lambda r: (first[r[1] or ""], r[1] or "", -1 if r[0] is None else r[0]))


@pytest.mark.parametrize("rows", [EDGE, [], None, [(i, "same text") for i in range(100)], [(5, "x" * 10_000)] + [(i, "y") for i in range(50)], [(None, f"t{i % 40}") for i in range(2000)], [(i * 7919 % 2000, f"t{i % 900}") for i in range(2000)]])
def test_shards(spark, rows):
    docs = common.table(spark, SF, "documents") if rows is None else clashing(documents(spark, rows))
    rows = [(r.doc_id, r.text) for r in docs.collect()] if rows is None else rows
    got = sharding.assign_shards(docs).collect()
    size = lambda t: len((t or "").encode()) + 8
    crc = lambda t: zlib.crc32((t or "").encode())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, size(t), crc(t)) for i, t in rows)
    assert all(r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 24 for r in got)
    per = Counter()
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        assert r.slot == per[r.shard]
        per[r.shard] += 1
    total, groups = sum(r["size"] for r in got), Counter(t or "" for _, t in rows)
    if rows and len({i for i, _ in rows}) == len(rows):  # the law, row by row
        of, before, begun = {(r.doc_id, r.text_crc32): r.shard for r in got}, 0, {}
        for i, t in in_groups(rows):
            begin, all_bytes = begun.setdefault(t or "", before), groups[t or ""] * size(t)
            middle = 2 * begin + all_bytes if all_bytes * 24 * 20 <= total else 2 * before + size(t)
            assert of[i, crc(t)] == min(23, middle * 24 // (2 * total))
            before += size(t)
    shards = {}
    for r in got:
        shards.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
    assert all(len(shards[size(t), crc(t)]) == 1 for t, n in groups.items() if n * size(t) * 24 * 20 <= total)
    per = Counter()
    for r in got:
        per[r.shard] += r["size"]
    most = max([size(t) * (n if n * size(t) * 24 * 20 <= total else 1) for t, n in groups.items()], default=0)
    assert all(abs(per[k] - total / 24) <= most + 1 for k in range(24))


def test_written_shards(spark, tmp_path):
    docs = clashing(common.table(spark, SF, "documents"))
    docs = docs.withColumn("__shard", F.lit("own")).unionByName(docs.limit(3).withColumn("__shard", F.lit("own"))).unionByName(docs.limit(1).withColumns({"text": F.lit("other"), "__shard": F.lit("own")}))
    folder = sharding.write_shards(docs, str(tmp_path / "s"), 5)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert folder == "__shard_" and back.columns == [*docs.columns, folder]
    assert sorted(str(r[:-1]) for r in map(tuple, back.collect())) == sorted(str(tuple(r)) for r in docs.collect())
    placed = Counter((r.doc_id, r.text_crc32, r.shard) for r in sharding.assign_shards(docs, 5).collect())
    assert Counter((r.doc_id, zlib.crc32((r.text or "").encode()), r[folder]) for r in back.collect()) == placed


def hashes(print_):
    return {print_[i : i + 16] for i in range(0, len(print_), 16)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def slow_grams(text):
    """(hash, position) of the chosen grams, window by window."""
    k, w = winnow.GRAM, winnow.WINDOW
    h = [xxhash.xxh64_intdigest(text[i : i + k].encode("utf-32-be"), 42) for i in range(max(1, len(text) - k + 1))] if text else []
    signed = [x - (1 << 64) if x >> 63 else x for x in h]
    out = []
    for i in range(max(1, len(h) - w + 1) if h else 0):
        at = min(range(i, min(i + w, len(h))), key=lambda p: (signed[p] >> 32, -p))
        if not out or out[-1] != (signed[at], at):
            out.append((signed[at], at))
    return out


def slow_print(text):
    return "".join(f"{h & (1 << 64) - 1:016x}" for h, _ in slow_grams(text))


CJK = "".join(chr(0x4E00 + i * i * 7919 % 20_000) for i in range(1000))


SHORT = [(i, "the quick brown fox jumps over the lazy dog and sleeps"[: i % 56] * (1 + i // 56)) for i in range(180)]


@pytest.mark.parametrize("rows", [EDGE, [], [(1, "just one document of some words")], None, SHORT, SHORT[::-3], [(None, f"text {i % 400} of a null id") for i in range(900)] + [(1, CJK)]])
@pytest.mark.parametrize("hot", [10_000, 100])
def test_against_next(spark, rows, hot, monkeypatch):
    """All columns by the slow version, whose order among equal ids is that of the rows that come back."""
    monkeypatch.setattr(winnow, "HOT_ROWS", hot)
    docs = common.table(spark, SF, "documents") if rows is None else clashing(documents(spark, rows))
    rows = [(r.doc_id, r.text or "") for r in docs.collect()] if rows is None else [(i, t or "") for i, t in rows]
    key = lambda t: (lambda x: x - (1 << 64) if x >> 63 else x)(xxhash.xxh64_intdigest(t.encode(), 42))
    chain = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, key(r[1]), r[1].encode()))[::-1]
    prints = {t: slow_print(t) for _, t in rows}
    want = Counter()
    for k, (i, t) in enumerate(chain):
        following, half = chain[(k + 1) % len(chain)][1], len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        print_ = slow_print(edited)
        near = jaccard(hashes(prints[t]), hashes(print_)), jaccard(hashes(prints[t]), hashes(prints[following]))
        want[i, len(t), hashlib.sha256(edited.encode()).hexdigest(), prints[t], print_, *(round(x, 9) for x in near)] += 1
    got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in winnow.compare_with_next(docs).collect())
    assert got == want


def spark_grams(spark, texts):
    rows = winnow.fingerprints(documents(spark, list(enumerate(texts)))).collect()
    return [[(g["hash"], g["position"]) for g in r.grams] for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("span", [16, 17, 1 << 14])
def test_windows_and_rightmost_ties(spark, span, monkeypatch):
    monkeypatch.setattr(winnow, "SPAN", span)
    texts = ["ab" * 200, "a" * 100, "abc", "", "x" * 23 + "y" * 23, "🙂é漢 words and more words, and more words " * 9, "w" * 15, CJK]
    texts += [("".join(chr(97 + i * i % 23) for i in range(n))) for n in (7, 8, 9, 22, 23, 24, 31, 32, 33, 39, 40, 55)]
    assert spark_grams(spark, texts) == [slow_grams(t) for t in texts]


def test_guarantee(spark):
    """Any GRAM + WINDOW - 1 shared characters share a chosen gram, wherever they stand."""
    shared = "".join(chr(0x3400 + i) for i in range(winnow.GRAM + winnow.WINDOW - 1))
    texts = ["".join(chr(0x5000 + 300 * k + i) for i in range(7 * k)) + shared + "".join(chr(0x9000 + 40 * k + i) for i in range(30 - k)) for k in range(8)]
    sets = [{h for h, _ in g} for g in spark_grams(spark, texts)]
    assert all(a & b for a in sets for b in sets)


def test_texts_without_blanks_are_near_their_edits(spark):
    rows = [(1, CJK[::-1]), (2, CJK), (3, "base64" * 3 + "Zm9vYmFyYmF6" * 90)]
    got = {r.doc_id: r for r in winnow.compare_with_next(documents(spark, rows)).collect()}
    assert got[2].near_edited > 0.25 and got[1].near_edited > 0.25 and got[2].near_next < 0.05


def test_native_plan(spark):
    plan = winnow.compare_with_next(common.table(spark, SF, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
