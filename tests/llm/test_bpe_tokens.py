import base64
import hashlib
import json
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from tokenizers import Tokenizer

from sparkwarden.llm import bpe, common, token_files
from sparkwarden.llm.queries import BYTE_BPE, END_ID, WORD_BPE

from .helpers import EDGE, SF, clashing, documents

PATH = P.path(BYTE_BPE)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def words():
    t = Tokenizer.from_file(P.path(WORD_BPE))
    t.encode_special_tokens = True
    return t


def random_texts(n, seed):
    r = random.Random(seed)
    letters = "aabbcde  \n\té漢字🙂's1²½\x1c 　́\x85ABtheoning!!!???...---===\xa0  "
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(n)]


HARD = ["a" * n for n in (1, 2, 3, 7, 100, 50_000)] + [" " * n + "x" for n in (1, 2, 50)] + ["ab" * 20_000, "aaab" * 5000, "\n" * 77 + "  ", "=-" * 500, "<|endoftext|> it's"]


def test_ids_equal_the_library(library):
    texts = random_texts(4000, 1) + HARD
    coder = bpe.Coder(PATH, P.PATTERN)
    for at in range(0, len(texts), 500):
        for text, ids in zip(texts[at : at + 500], coder.encode(texts[at : at + 500]), strict=True):
            assert ids == library.encode_ordinary(text)
            assert coder.v.decode(ids) == text.encode()


def test_forgetting_changes_nothing(library):
    coder = bpe.Coder(PATH, P.PATTERN, keep_units=5)
    for text in random_texts(200, 2):
        assert list(coder.encode([text, text])) == [library.encode_ordinary(text)] * 2


def digest(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


@pytest.mark.parametrize("rows", [EDGE, []])
def test_documents(spark, library, rows):
    got = bpe.encode_documents(clashing(documents(spark, rows)), PATH, P.PATTERN)
    want = [(i, library.encode_ordinary(t or ""), t or "") for i, t in rows]
    key = lambda x: (x[0] is not None, x[0] or 0)
    assert sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in got.collect()), key=key) == sorted(((i, len(x), digest(x), hashlib.sha256(t.encode()).hexdigest(), x) for i, x, t in want), key=key)
    back = sorted(((r.doc_id, bytes(r.bytes)) for r in bpe.decode_ids(got, PATH).collect()), key=key)
    assert back == sorted(((i, t.encode()) for i, _, t in want), key=key)


def test_word_ids_equal_the_library(words):
    coder = token_files.WordIds(P.path(WORD_BPE))
    r = random.Random(3)
    parts = ["é", "É", "a", "B", "the", "'s", "'", "n't", "!", "...", "漢", "ß", "ẞ", "İ", "ǅ", "é", "́", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "1", "23", "½", "ª", "µ", "_", "<|endoftext|>", "Σ", "ΑΣ", "🙂", "-", "&", "|", "\x00", "​"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)] + HARD
    for text, raw in zip(texts, coder.encode(texts, b""), strict=True):
        assert np.frombuffer(raw, coder.type).tolist() == words.encode(text, add_special_tokens=False).ids


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))


@pytest.mark.parametrize("rows", [EDGE, [], None])
def test_token_files(spark, words, rows, monkeypatch):
    monkeypatch.setattr(token_files, "BLOCK_BYTES", 2000)
    docs = common.table(spark, SF, "documents") if rows is None else clashing(documents(spark, rows))
    rows = [(r.doc_id, r.text) for r in docs.collect()] if rows is None else rows
    got = by_id([(r.doc_id, r.start, r.n_tokens, r.ids_crc32, list(r.ids)) for r in token_files.round_trip(docs, P.path(WORD_BPE), END_ID, with_ids=True).collect()])
    want, start = [], 0
    for i, t in by_id(rows):
        ids = words.encode(t or "", add_special_tokens=False).ids + [END_ID]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        start += len(ids)
    assert got == want


def test_short_documents_are_read_alone(spark, tmp_path):
    docs, path = common.table(spark, SF, "documents"), str(tmp_path / "files")
    token_files.write_token_files(docs, path, P.path(WORD_BPE), END_ID)
    whole = {r.doc_id: r for r in token_files.read_token_files(spark, path).collect()}
    few = token_files.read_token_files(spark, path, doc_ids=[3, 77, 123_456]).collect()
    assert {r.doc_id: r for r in few} == {i: whole[i] for i in (3, 77)}
    row = spark.read.parquet(f"{path}/dictionary").first()
    assert row.dict_sha256 == hashlib.sha256(bytes(row.bytes)).hexdigest()
    spark.createDataFrame([("0" * 64, bytearray(row.bytes))], "dict_sha256 string, bytes binary").write.mode("overwrite").parquet(f"{path}/dictionary")
    with pytest.raises(Exception, match="written with dictionary"):
        token_files.read_token_files(spark, path).collect()


def test_other_vocabulary_files_take_the_whole_way(tmp_path):
    said = json.loads(open(P.path(WORD_BPE), encoding="utf-8").read())
    said["normalizer"] = {"type": "NFC"}
    (tmp_path / "other.json").write_text(json.dumps(said))
    t = Tokenizer.from_file(str(tmp_path / "other.json"))
    t.encode_special_tokens = True
    coder = token_files.WordIds(str(tmp_path / "other.json"))
    texts = ["Hello World", "", "a  b", *random_texts(50, 4)]
    assert not coder.by_word and token_files.WordIds(P.path(WORD_BPE)).by_word
    assert [np.frombuffer(x, coder.type).tolist() for x in coder.encode(texts, b"")] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def test_null_ids_are_dealt_like_others(spark, monkeypatch):
    """The dictionary's sample is bounded though all ids are null, and parts share out one id's rows."""
    docs = documents(spark, [(None, f"word{i} and {i * i}") for i in range(3000)])
    monkeypatch.setattr(token_files, "SAMPLE_DOCS", 100)
    path = common.shared_dir(spark) + "/null-ids"
    token_files.write_token_files(docs, path, P.path(WORD_BPE), END_ID)
    got = token_files.read_token_files(spark, path).collect()
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert len(got) == 3000 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
    assert spark.read.parquet(f"{path}/bases").count() > 1
