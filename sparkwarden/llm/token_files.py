"""Token-id files: zstandard frames with a shared dictionary, one a document.

A dataset is a folder of three Parquet tables, written by Spark's own writer so
that any file system Spark knows will do:

* ``dictionary``: dict_sha256, bytes. One row: a zstandard dictionary, trained on the
  serialized ids (little-endian unsigned 16-bit, or 32-bit for larger
  vocabularies) of a bounded sample of documents: SAMPLE_DOCS of them in expectation, picked by
  a seeded random number whatever their ids, and of these whole ones up to SAMPLE_BYTES of ids; empty if the sample is too small to train on.
* ``blocks``: part, block, start, dict_sha256, doc_ids, n_tokens, offsets, data. A
  block holds about BLOCK_BYTES of frames in ascending doc_id order; frame i
  is data[offsets[i]:offsets[i+1]], so one short document is read by
  inflating its own frame alone. The dictionary's hash guards against another.
* ``bases``: part, base. Ids before each part.

Parts are ranges of (doc_id, tokens, hash of the frame), cut by Spark's range partitioner, so that rows with equal or
null ids are dealt over several tasks too.

Where the vocabulary file's normalizer and splitter are those that this module knows (SPLITS_AT_SPACE),
words between white space are encoded by the tokenizers library, which splits
there itself, once for each worker that meets them. Whole texts go to the library under any other file.

Defined results: null and empty texts have the end id alone. Special tokens'
strings in a text are ordinary text. Null ids come first, and rows with equal
ids follow each other in the order of their token counts, then of their frames' hashes. In
``read_token_files`` an id in ``doc_ids`` that several rows have brings them all. Other
columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import json
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .bpe import SPACE

WORD = re.compile(f"[^{SPACE}]+")
#: Text bytes that a task encodes at once.
SLICE_BYTES = 3 << 20
#: Latin letters that Unicode composes no further, then marks that the splitter takes as one piece.
PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?#$%&*)(|-]*)").fullmatch
#: Words whose ids a worker keeps; beyond it, it forgets those not met since it last forgot.
KEEP_WORDS = 350_000
SAMPLE_DOCS = 1000
SAMPLE_BYTES = 16 << 20
DICT_BYTES = 64 << 10
BLOCK_BYTES = 1 << 20
LEVEL = 1


#: The normalizer and the splitter of a vocabulary file under which a text's ids are those of its words between white space.
SPLITS_AT_SPACE = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(other)}


class WordIds:
    """Serialized ids of words, by the tokenizers library.

    A word of plain letters, with or without plain marks after them, goes to the library's
    merge model directly: its normalizer does no more to it than lower-case it, and its splitter cuts it
    before the marks. Every other word takes the library's whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            said = f.read()
        self.t = Tokenizer.from_str(said)
        self.t.encode_special_tokens = True
        parts = json.loads(said)
        self.by_word = (parts["normalizer"], parts["pre_tokenizer"]) == SPLITS_AT_SPACE and not any(x["normalized"] or not x["special"] for x in parts["added_tokens"])
        self.model = self.t.model
        self.letters = byte_letters()
        self.type = np.dtype("<u2" if self.t.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.type.itemsize == 2 else "I"
        self.known = Known(self.make)
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def piece(self, p: str) -> bytes:
        ids = self.pieces.get(p)
        if ids is None:
            symbols = p if p.isascii() else p.encode().decode("latin-1").translate(self.letters)
            ids = self.pieces[p] = array(self.code, [x.id for x in self.model.tokenize(symbols)]).tobytes()
        return ids

    def make(self, w: str) -> bytes:
        """The ids of a word that isn't known."""
        ids = self.older.get(w)
        if ids is not None:
            return ids
        if w.isascii() and w.islower() and w.isalpha():
            return self.piece(w)
        if plain := PLAIN(w):
            letters, marks = plain.groups()
            return self.piece(letters.lower()) + self.piece(marks) if marks else self.piece(letters.lower())
        return array(self.code, self.t.encode(w, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str], end: bytes) -> list[bytes]:
        if not self.by_word:
            return [array(self.code, self.t.encode(t, add_special_tokens=False).ids).tobytes() + end for t in texts]
        if len(self.known) > KEEP_WORDS:
            self.known, self.older = Known(self.make), self.known
        if len(self.pieces) > KEEP_WORDS:
            self.pieces = {}
        of = self.known.__getitem__
        collecting = gc.isenabled()
        gc.disable()  # nothing here has cycles
        try:
            return [b"".join(map(of, _words(_lowered(t)))) + end for t in texts]
        finally:
            if collecting:
                gc.enable()


class Known(dict):
    """Ids by word; a word that is asked for first is made."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make

    def __missing__(self, word: str) -> bytes:
        ids = self[word] = self.make(word)
        return ids


def _lowered(text: str) -> str:
    """Lower case, as the library's normalizer would, where that is letter by letter: below U+0100."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text
    return text.lower()


def _words(text: str) -> list[str]:
    """Runs without white space. str.split() also cuts at four control characters that aren't White_Space."""
    return WORD.findall(text) if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()


def word_ids(path: str) -> WordIds:
    """One for each worker process and vocabulary."""
    return common.resident(("token-files", path), lambda: WordIds(path))


def _compressor(d: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(d) if d else None)


def _decompressor(d: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(d) if d else None)


def _train(docs: DataFrame, vocabulary: str) -> bytes:
    """The dictionary, made by one task from the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, held = [], 0
        for batch in common.slices(batches, 1, keep=("token-files", vocabulary)):
            coder = word_ids(vocabulary)
            for ids in coder.encode([t or "" for t in batch.column(1).to_pylist()], b""):
                if held + len(ids) <= SAMPLE_BYTES:
                    held += len(ids)
                    samples.append(ids)
        try:
            made = zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
        except zstandard.ZstdError:  # too few or too short samples
            made = b""
        yield pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["bytes"])

    share = SAMPLE_DOCS / max(1, docs.count())
    sample = (docs.filter(F.rand(17) < share) if share < 1 else docs).repartition(1)
    rows = sample.mapInArrow(run, "bytes binary").collect()  # one row of DICT_BYTES at most
    return bytes(rows[0]["bytes"]) if rows else b""


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    spark = docs.sparkSession
    docs = common.key_text(docs, id_col, text_col)
    trained = _train(docs, vocabulary)
    sha = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(sha, bytearray(trained))], "dict_sha256 string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    n = common.n_partitions(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = _compressor(trained)
        for batch in common.slices(batches, 1, SLICE_BYTES, ("token-files", vocabulary)):
            coder = word_ids(vocabulary)
            end = np.array([end_id], coder.type).tobytes()
            raw = coder.encode([t or "" for t in batch.column(1).to_pylist()], end)
            counts = pa.array([len(x) // coder.type.itemsize for x in raw], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array([press.compress(x) for x in raw], pa.binary())], names=["doc_id", "n_tokens", "frame"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block, start, rows, held = 0, 0, [], 0

        def made() -> pa.RecordBatch:
            ids, counts, frames = zip(*rows, strict=True)
            at = [0, *accumulate(map(len, frames))]
            return pa.RecordBatch.from_pylist([{"part": part, "block": block, "start": start, "dict_sha256": sha, "doc_ids": list(ids), "n_tokens": list(counts), "offsets": at, "data": b"".join(frames)}], schema=BLOCKS)

        for batch in batches:
            for i, k, frame in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and held >= BLOCK_BYTES:
                    yield made()
                    start, block, rows, held = start + sum(r[1] for r in rows), block + 1, [], 0
                rows.append((i, k, frame))
                held += len(frame)
        if rows:
            yield made()

    frames = common.written(docs.mapInArrow(encode, "doc_id long, n_tokens long, frame binary"), "token-frames")  # the range partitioner reads its input twice
    order = [F.col("doc_id").asc_nulls_first(), "n_tokens", F.xxhash64("frame")]
    (
        frames.repartitionByRange(n, *order)
        .sortWithinPartitions(*order)
        .mapInArrow(pack, "part int, block int, start long, dict_sha256 string, doc_ids array<long>, n_tokens array<long>, offsets array<long>, data binary")
        .write.option("compression", "none")
        .parquet(f"{path}/blocks")
    )
    sums = spark.read.parquet(f"{path}/blocks").groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, b: a + b)).alias("n"))
    totals = {r["part"]: r["n"] for r in sums.collect()}  # one row a part
    parts = sorted(totals)
    before = [0, *accumulate(totals[p] for p in parts)]
    spark.createDataFrame(list(zip(parts, before, strict=False)), "part int, base long").coalesce(1).write.parquet(f"{path}/bases")


BLOCKS = pa.schema(
    [
        ("part", pa.int32()),
        ("block", pa.int32()),
        ("start", pa.int64()),
        ("dict_sha256", pa.string()),
        ("doc_ids", pa.list_(pa.int64())),
        ("n_tokens", pa.list_(pa.int64())),
        ("offsets", pa.list_(pa.int64())),
        ("data", pa.binary()),
    ]
)


def _dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row["dict_sha256"], bytes(row["bytes"])


def read_token_files(spark: SparkSession, path: str, wide: bool = False, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 and, if wanted, ids, inflated from the frames.

    ``doc_ids`` (a short list) reads only those documents' frames. ``wide``: the ids take
    32 bits, as the vocabulary has over 65,536.
    """
    sha, trained = _dictionary(spark, path)
    kind = np.dtype("<u4" if wide else "<u2")
    wanted = None if doc_ids is None else set(doc_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = _decompressor(trained)
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != sha:
                    raise ValueError(f"block was written with dictionary {row['dict_sha256']}")
                start, out = row["base"] + row["start"], []
                for i, (doc, n) in enumerate(zip(row["doc_ids"], row["n_tokens"], strict=True)):
                    if wanted is None or doc in wanted:
                        ids = np.frombuffer(press.decompress(row["data"][row["offsets"][i] : row["offsets"][i + 1]]), kind).astype("<u4")
                        out.append((doc, start, len(ids), zlib.crc32(ids), ids.astype(np.int32) if with_ids else None))
                    start += n
                if out:
                    columns = list(zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())), strict=True)][: 4 + with_ids], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 4 + with_ids])

    blocks = spark.read.parquet(f"{path}/blocks").select("part", "start", "dict_sha256", "doc_ids", "n_tokens", "offsets", "data")
    if wanted is not None:
        blocks = blocks.filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(x)).cast("long") for x in sorted(wanted)])))
    bases = spark.read.parquet(f"{path}/bases")  # one row a part
    return blocks.join(F.broadcast(bases), "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def round_trip(docs: DataFrame, vocabulary: str, end_id: int, with_ids: bool = False) -> DataFrame:
    """Writes ``docs`` to a new dataset in the shared folder and reads it back."""
    path = f"{common.shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, vocabulary, end_id)
    return read_token_files(docs.sparkSession, path, word_ids(vocabulary).type.itemsize == 4, with_ids=with_ids)
