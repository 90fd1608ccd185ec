"""Operator 7: repeated word windows by recompression.

A document's words are symbols. Each round names maximal runs of one symbol and
then pairs of a left-class symbol followed by a right-class symbol; the class is
one bit of the name. A name is a 64-bit hash of what it stands for, so all tasks
name equal runs and pairs alike without a shuffle. For every symbol the words
that decide it are known: equal windows hold the same symbols wherever those
words lie inside the window. Each window picks the symbol with the smallest
mixed name among them (a window without one, as inside a long run of one word,
picks itself). Symbols that occur twice or more reveal the windows that may
repeat; equal contexts and then the windows' own words verify them.

Windows count as equal by two 64-bit hashes that mix at every step: the symbol's
name and its context, or two hashes of the window that differ in their seeds, so
that a wrong hit has a chance of 2**-128 for each pair of different windows
(2**-64 where two words of more than 8 bytes share a hash and all others agree).

Defined results: a null text has no words; a null doc_id comes after all others
(of several, by a digest of the row); rows of one doc_id with different texts are
different documents in the order of that digest; equal rows are one document given
again and do not count as earlier; windows do not cross documents; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwell.llm.repeats import Picked, anchor_rows, range_minimum, runs_of_anchors, shared_anchors, windows_in, with_marks
from pitwell.llm.shared import Words, as_long, both, covered, documents, mix, span_hash, spread_join, stored, told_apart, window_hash

WINDOW = 20
ROUNDS = 2
_ODD = np.uint64(0xC2B2AE3D27D4EB4F)
#: Beyond all words: a symbol that depends on where its document begins or ends.
FAR = np.int64(1) << 40


def recompress(name: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of the last round's symbols and the range of words [low, high) that decides each."""
    low = np.arange(len(name), dtype=np.int64)
    high = low + 1
    for r in range(rounds):
        if not len(name):
            break
        # Runs: a run, also of one symbol, is decided by its neighbours too.
        border = np.ones(len(name), bool)
        border[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(border)
        length = np.diff(np.append(at, len(name)))
        last = at + length - 1
        inner_low, inner_high = low[at], high[last]
        run_doc = doc[at]
        name = np.where(length > 1, mix(name[at] + length.astype(np.uint64) * _ODD + np.uint64(2 * r + 1)), name[at])
        inner = np.zeros(len(at), bool)
        inner[1:] = run_doc[1:] == run_doc[:-1]
        low = np.where(inner, np.append(-FAR, inner_low[:-1]), -FAR)
        inner = np.append(inner[1:], False)
        high = np.where(inner, np.append(inner_high[1:], FAR), FAR)
        doc = run_doc
        # Pairs: left class followed by right class, in one document. They cannot overlap.
        right = (mix(name + np.uint64(r)) & np.uint64(1)).astype(bool)
        pair = np.zeros(len(name), bool)
        pair[:-1] = ~right[:-1] & right[1:] & (doc[:-1] == doc[1:])
        second = np.append(False, pair[:-1])
        next_low, next_high = np.append(low[1:], -FAR), np.append(high[1:], FAR)
        before_low, before_high = np.append(-FAR, low[:-1]), np.append(FAR, high[:-1])
        next_high[:-1][doc[:-1] != doc[1:]] = FAR
        before_low[1:][doc[:-1] != doc[1:]] = -FAR
        # A left-class symbol is decided with the one behind it, a right-class one with the one before it.
        new_low = np.where(right, np.minimum(low, before_low), low)
        new_high = np.where(right, high, np.maximum(high, next_high))
        following = np.append(name[1:], np.uint64(0))
        named = np.where(pair, mix(mix(name) + following * _ODD), name)
        keep = ~second
        name, low, high, doc = named[keep], new_low[keep], new_high[keep], doc[keep]
    return name, low, high


def pick(texts: pa.Array, size: int = WINDOW, rounds: int = ROUNDS) -> tuple[Picked, np.ndarray]:
    w = Words(texts)
    window, hashes = w.windows(size)
    name, low, high = recompress(w.hash, w.doc, rounds)
    sound = (low >= 0) & (high < FAR)
    low, high = low[sound], high[sound]
    # A short symbol is common by itself; with all the words that decide it, it is as rare as a long one.
    name = both(name[sound], span_hash(w.hash, low, high))
    a = np.searchsorted(low, window)
    b = np.searchsorted(high, window + size, "right")
    some = b > a
    bits = np.uint64(max(1, len(name)).bit_length())
    keys = (mix(name ^ _ODD) >> bits << bits) | np.arange(len(name), dtype=np.uint64)
    chosen = np.full(len(window), -1, np.int64)
    if some.any():
        best = range_minimum(keys, a[some], b[some])
        chosen[some] = (best & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    names = np.where(some, name[np.maximum(chosen, 0)] if len(name) else hashes, mix(hashes))
    anchor = np.where(some, chosen, -1 - window)
    return runs_of_anchors(anchor, window, w.doc[window], names, w.hash, size), w.first


def representative_windows(docs: DataFrame, runs: DataFrame, size: int) -> DataFrame:
    """doc_id, start, window, check: two hashes of the windows of the given runs (doc_id, start, n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                w = Words(b.column(1).slice(i, 1))
                at = windows_in(b.column(2)[i].as_py(), b.column(3)[i].as_py(), max(0, len(w.start) - size + 1))
                hashes, check = window_hash(w.hash, size)[at], window_hash(mix(w.hash + _ODD), size)[at]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(at), i))), pa.array(at.astype(np.int32)), as_long(hashes), as_long(check)], names=["doc_id", "start", "window", "check"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_marks(docs, runs, "inner").mapInArrow(run, f"doc_id {kind}, start int, window long, check long")


def later_windows(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, start, n: runs of windows whose word sequence also starts earlier."""
    shared = shared_anchors(anchor_rows(docs, lambda texts: pick(texts, size)), "op7")
    place = F.struct("doc_id", "start")
    firsts = shared.contexts.filter("copies > 1").select("name", "context", "copies", F.struct("first.doc_id", "first.start").alias("earliest"))
    copies = spread_join(shared.members, firsts, ["name", "context"], count="copies").filter(place != F.col("earliest")).select("doc_id", "start", "n")
    runs = shared.contexts.filter("contexts > 1").select("first.*")
    windows = stored(representative_windows(docs, runs, size).distinct(), "op7-windows")
    earliest = windows.groupBy("window", "check").agg(F.count("*").alias("c"), F.min(place).alias("earliest")).filter("c > 1")
    later = spread_join(windows, stored(earliest, "op7-earliest"), ["window", "check"], count="c").filter(place != F.col("earliest")).select("doc_id", "start", F.lit(1).alias("n"))
    return copies.unionByName(later)


def without_repeats(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept: the words left of every document, joined by one space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                words = (b.column(1)[i].as_py() or "").encode().split()
                at = windows_in(b.column(2)[i].as_py(), b.column(3)[i].as_py(), max(0, len(words) - size + 1))
                kept = words
                if len(at):
                    gone = covered(at, size, len(words))
                    kept = [x for x, g in zip(words, gone.tolist()) if not g]
                out.append((len(words), len(words) - len(kept), b" ".join(kept).decode()))
            n, gone, kept = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    docs, out = told_apart(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = with_marks(docs, later_windows(docs, size)).mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")
    return found.select(out.alias("doc_id"), "n_words", "n_removed", "kept")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
