"""Operator 3: language identification with hyperdimensional profiles.

Every letter has a pseudo-random vector of +-1 in D dimensions. An n-gram's
vector binds (multiplies) its letters' vectors, each permuted (rotated) by its
place; a document's vector bundles (adds) its n-grams' vectors, and a language's
prototype bundles the documents of that language, each scaled to length one. The
language of a document is that of the prototype with the largest cosine, after
the mean of all prototypes is taken off both.

Letters outside basic and extended Latin share 127 vectors by a hash. Learning
takes every training row (a sum per language and partition: languages x D
numbers); only those sums reach the driver.

Defined results: `und` and score 0 for a null text or one without letters; with
no training row at all, every text is `und`; a null doc_id counts as '' in the
fold's crc32; other columns are never inputs of a prediction.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwell.llm.shared import documents, slices

DIMENSIONS = 1024
GRAM = 3
FOLDS = 5
SEED = 7
#: Bytes of text whose n-gram counts are bundled by one matrix product.
BUNDLE_BYTES = 1 << 18
#: N-gram vectors that a worker holds at once, 4 KB each.
MOST_GRAMS = 40_000


class Letters:
    """Symbols of code points (0: no letter) and vectors of n-grams, made once for each Python worker."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.vectors = rng.choice(np.array([-1, 1], np.int8), (256, DIMENSIONS))
        self.symbols = np.zeros(0x110000, np.uint8)
        latin = 1
        points = np.arange(0x110000)
        category = np.frombuffer("".join(unicodedata.category(chr(i))[0] for i in range(0x110000)).encode(), np.uint8)
        letters = points[category == ord("L")]
        self.symbols[letters] = 128 + (letters * 2654435761 >> 16) % 127
        for i in range(0x180):
            if chr(i).isalpha() and chr(i).lower() == chr(i):
                self.symbols[i] = min(latin, 127)
                latin += 1
        for i in letters:
            low = chr(i).lower()
            if len(low) == 1 and ord(low) != i:
                self.symbols[i] = self.symbols[ord(low)]
        self.rows = np.full(1 << (8 * GRAM), -1, np.int32)
        self.grams = np.zeros((0, DIMENSIONS), np.float32)

    def gram_rows(self, codes: np.ndarray) -> np.ndarray:
        """Row of each of at most MOST_GRAMS distinct n-gram codes in `grams`; unseen ones get their vector now."""
        new = codes[self.rows[codes] < 0]
        if len(self.grams) + len(new) > MOST_GRAMS:  # bounded memory: start again before any is added
            self.rows.fill(-1)
            self.grams = np.zeros((0, DIMENSIONS), np.float32)
            new = codes
        if len(new):
            v = np.ones((len(new), DIMENSIONS), np.float32)
            for place in range(GRAM):
                v *= np.roll(self.vectors[(new >> (8 * (GRAM - 1 - place))) & 255], place, axis=1)
            self.rows[new] = np.arange(len(self.grams), len(self.grams) + len(new))
            self.grams = np.concatenate([self.grams, v])
        return self.rows[codes]

    def bundle(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Document vectors scaled to length one, and the number of letters of each."""
        points = [np.frombuffer((t or "").encode("utf-32-le", "replace"), np.uint32) for t in texts]
        # A boundary on both sides of each text; runs without letters shrink to one boundary.
        flat = np.concatenate([np.append(p, 0) for p in points])
        doc = np.repeat(np.arange(len(texts)), [len(p) + 1 for p in points])
        s = self.symbols[flat]
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0)
        letters = np.bincount(doc, s > 0, len(texts)).astype(np.int64)
        s, doc = s[keep].astype(np.int32), doc[keep]
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        if len(s) >= GRAM and letters.any():
            code = s[2:] | s[1:-1] << 8 | s[:-2] << 16
            same = (doc[2:] == doc[:-2]) & (s[1:-1] > 0)
            used, place = np.unique(code[same], return_inverse=True)
            owner = doc[2:][same]
            # Blocks of distinct n-grams, whatever their number; sums of whole numbers don't depend on the blocks.
            for first in range(0, len(used), MOST_GRAMS):
                rows = self.gram_rows(used[first : first + MOST_GRAMS])
                inside = (place >= first) & (place < first + MOST_GRAMS)
                for a in range(0, len(texts), 64):
                    mine = inside & (owner >= a) & (owner < a + 64)
                    n = min(64, len(texts) - a)
                    counts = np.bincount((owner[mine] - a) * len(rows) + place[mine] - first, minlength=n * len(rows)).reshape(n, len(rows))
                    seen = np.flatnonzero(counts.any(axis=0))
                    out[a : a + n] += counts[:, seen].astype(np.float32) @ self.grams[rows[seen]]
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.maximum(length, 1e-9), letters


_letters: Letters | None = None


def letters() -> Letters:
    global _letters
    _letters = _letters or Letters()
    return _letters


def fold(docs: DataFrame):
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS


def prototypes(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their bundled vectors, learnt from all given rows with a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            for part in slices(b, limit=BUNDLE_BYTES):
                vectors, _ = letters().bundle(part.column(0).to_pylist())
                langs = np.array(part.column(1).to_pylist(), object)
                for lang in set(langs):
                    total[lang] = total.get(lang, 0) + vectors[langs == lang].sum(axis=0, dtype=np.float64)
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([total[n].tolist() for n in names], pa.list_(pa.float64()))], names=["lang", "v"])

    parts = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang").mapInArrow(run, "lang string, v array<double>")
    # Summed by place before and after the shuffle: no row holds the vectors of several tasks, the result has the size of the model.
    places = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    total = places.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p")).select("lang", F.col("p.x").alias("v")).orderBy("lang").collect()
    m = np.array([r.v for r in total], np.float64).reshape(len(total), DIMENSIONS)
    return [r.lang for r in total], m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def predicted(docs: DataFrame, languages: list[str], profile: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    centre = profile.mean(axis=0) if len(languages) > 1 else np.zeros(DIMENSIONS)
    shifted = profile - centre
    shifted = (shifted / np.maximum(np.linalg.norm(shifted, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, limit=BUNDLE_BYTES):
                vectors, n = letters().bundle(part.column("text").to_pylist())
                best, score = ["und"] * part.num_rows, np.zeros(part.num_rows)
                if languages:
                    v = vectors - centre.astype(np.float32)
                    cosine = v @ shifted.T / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
                    top = cosine.argmax(axis=1)
                    best = [languages[k] if c else "und" for k, c in zip(top, n)]
                    score = np.where(n > 0, np.clip((1 + cosine.max(axis=1)) / 2, 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select("doc_id", (fold(docs) == 0).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return predicted(docs, *prototypes(docs.filter(fold(docs) != 0)))
