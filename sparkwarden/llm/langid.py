"""Language identification with hyperdimensional vectors.

Every letter has a random vector of DIMENSIONS signs, made from a hash of the
letter alone. A trigram is bound by multiplying its letters' vectors, the
first permuted (rotated) twice and the second once; a document bundles (adds)
the vectors of all its trigrams, and a language's prototype bundles those of its training
documents, each scaled to length 1. The prediction is the prototype with the
largest cosine, and the score is that cosine, cut to 0 to 1.

Trigrams run over lower-cased letters, with one blank for whatever lies
between. Prototypes are sums over all training documents, added up in Spark: the
driver gets one vector a language.

Defined results: null texts, and texts without a letter, are ``und`` with
score 0. Equal cosines go to the language first in order. Rows with null or empty lang
aren't learnt from; without any, every prediction is ``und``. Rows come back
one each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, wordhash

DIMENSIONS = 1024
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
#: Trigram vectors that a worker keeps, and that it adds up at once: 128 and 16 MB.
KEEP, STRIP = 32_768, 4096
#: Texts that are bundled together, and how many of them make a trigram a shared one.
TOGETHER, SHARED = 128, 6


def held_out(id_col: Column) -> Column:
    """Rows that training must not see: crc32 of the id as text, modulo FOLDS, is HELD_OUT."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """Signs for each code point, from a hash of it and the dimension."""
    with np.errstate(over="ignore"):
        seed = wordhash.mix(letters.astype(np.uint64) + np.uint64(1))[:, None] + np.arange(DIMENSIONS // 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = np.unpackbits(wordhash.mix(seed).view(np.uint8), axis=1, bitorder="little")
    return (bits.astype(np.int8) * 2 - 1).astype(np.float32)


def trigrams(text: str | None) -> np.ndarray:
    """Codes of a text's trigrams; a text with letters has at least one."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    if not len(points):
        return np.zeros(0, np.int64)
    letter = _is_letter(points)
    if not letter.any():
        return np.zeros(0, np.int64)
    x = np.where(letter, points, 32).astype(np.int64)
    blank = x == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    x = np.concatenate([[32], x[keep], [32]])
    if x[1] == 32:
        x = x[1:]
    if x[-2] == 32:
        x = x[:-1]
    return x[:-2] << 42 | x[1:-1] << 21 | x[2:]


_LETTERS = np.zeros(0x110000, np.int8)  # 0: not looked up, 1: letter, 2: none


def _is_letter(points: np.ndarray) -> np.ndarray:
    kind = _LETTERS[points]
    if not kind.all():
        for p in np.unique(points[kind == 0]).tolist():
            _LETTERS[p] = 1 if chr(p).isalpha() else 2
        kind = _LETTERS[points]
    return kind == 1


class Bundler:
    """Bundled vectors of texts: each text's trigram counts times those trigrams' vectors.

    Memory is bounded whatever the texts: a table of KEEP trigram vectors, begun anew when it
    is full, and STRIP vectors at work.
    """

    def __init__(self):
        self.codes, self.slots = np.zeros(0, np.int64), np.zeros(0, np.int64)  # ascending codes, and where their vectors are
        self.table = np.empty((KEEP, DIMENSIONS), np.float32)

    def slots_of(self, codes: np.ndarray) -> np.ndarray:
        """Where the table has the vectors of distinct codes, at most STRIP, made where need be."""
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        new = codes if not len(self.codes) else codes[self.codes[at] != codes]
        if len(self.codes) + len(new) > KEEP:
            self.codes, self.slots, new = np.zeros(0, np.int64), np.zeros(0, np.int64), codes
        if len(new):
            begin = len(self.codes)
            parts = np.stack([new >> 42, new >> 21 & 0x1FFFFF, new & 0x1FFFFF])
            letters, where = np.unique(parts, return_inverse=True)
            of = letter_vectors(letters)
            first, second, third = where.reshape(3, -1)
            self.table[begin : begin + len(new)] = np.roll(of, 2, axis=1)[first] * np.roll(of, 1, axis=1)[second] * of[third]
            both, slots = np.concatenate([self.codes, new]), np.concatenate([self.slots, np.arange(begin, begin + len(new))])
            order = np.argsort(both, kind="stable")
            self.codes, self.slots = both[order], slots[order]
        return self.slots[np.searchsorted(self.codes, codes)]

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text: the sum of its trigram vectors, scaled to length 1 (or 0).

        Sums are of whole numbers, so their order doesn't matter: trigrams that many of TOGETHER texts have go
        through a matrix product, the others text by text.
        """
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        for at in range(0, len(texts), TOGETHER):
            grams = [trigrams(t) for t in texts[at : at + TOGETHER]]
            codes, where = np.unique(np.concatenate(grams), return_inverse=True)
            pair, counts = np.unique(np.repeat(np.arange(len(grams)), [len(g) for g in grams]) * len(codes) + where, return_counts=True)
            text, code = pair // max(1, len(codes)), pair % max(1, len(codes))
            common_code = np.bincount(code, minlength=len(codes)) >= SHARED
            shared = np.flatnonzero(common_code)
            column = np.cumsum(common_code) - 1
            many = common_code[code]
            row, col, value = text[many], column[code[many]], counts[many].astype(np.float32)
            for k in range(0, len(shared), STRIP):
                strip = shared[k : k + STRIP]
                inside = (col >= k) & (col < k + STRIP)
                dense = np.zeros((len(grams), len(strip)), np.float32)
                dense[row[inside], col[inside] - k] = value[inside]
                out[at : at + len(grams)] += dense @ self.table[self.slots_of(codes[strip])]
            row, col, value = text[~many], code[~many], counts[~many].astype(np.float32)
            cut = np.searchsorted(row, np.arange(len(grams) + 1)).tolist()
            for t in range(len(grams)):
                for k in range(cut[t], cut[t + 1], STRIP):
                    upto = min(k + STRIP, cut[t + 1])
                    out[at + t] += value[k:upto] @ self.table[self.slots_of(codes[col[k:upto]])]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length > 0, length, 1)


def bundler() -> Bundler:
    """One for each worker process."""
    return common.resident(("langid",), Bundler)


def prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and a vector of length 1 for each, over all rows."""
    rows = docs.filter(F.length(F.col(lang_col).cast("string")) > 0).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in common.slices(batches, 1, keep=("langid",)):
            b = bundler()
            langs = np.array(batch.column(0).to_pylist())
            made = b.bundle(batch.column(1).to_pylist())
            for lang in np.unique(langs).tolist():
                total[lang] = total.get(lang, 0) + made[langs == lang].sum(0, dtype=np.float64)
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x in total for _ in range(DIMENSIONS)]), pa.array(np.tile(np.arange(DIMENSIONS, dtype=np.int32), len(total))), pa.array(np.concatenate(list(total.values())))],
                names=["lang", "at", "value"],
            )

    sums = rows.mapInArrow(run, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value").alias("value"))
    found = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("v")).orderBy("lang").collect()  # one vector a language
    vectors = np.array([[x["value"] for x in r["v"]] for r in found]).reshape(-1, DIMENSIONS)
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return [r["lang"] for r in found], vectors / np.where(length > 0, length, 1)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score."""
    langs, vectors = model
    vectors = vectors.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1, keep=("langid",)):
            b = bundler()
            made = b.bundle(batch.column(1).to_pylist())
            names, best = [UNKNOWN] * len(made), np.zeros(len(made))
            if langs:
                cosines = made @ vectors.T
                top = cosines.argmax(1)
                some = made.any(1)
                names = [langs[k] if s else UNKNOWN for k, s in zip(top.tolist(), some.tolist(), strict=True)]
                best = np.clip(np.where(some, cosines[np.arange(len(made)), top], 0), 0, 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(best.astype(np.float64))], names=["doc_id", "lang_pred", "score"])

    return common.key_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score; learns from the rows that aren't held out."""
    model = prototypes(docs.filter(~held_out(F.col(id_col))), text_col, lang_col)
    return predict(docs, model, id_col, text_col).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
