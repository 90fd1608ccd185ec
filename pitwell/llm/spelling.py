"""Operator 12: spelling variants by permuterm rotations.

Every word is marked with a terminator and rotated to each of its places. A
rotation without its last symbol is what stays when one character (the one that
now stands last) is edited, so words that differ by a replaced character share
such a prefix, and the shorter word of an insertion or deletion is itself, as a
whole rotation, the prefix of the longer one. Rotations are dealt out in ranges of
the sorted prefixes; one scan of each range sees a group of equal prefixes side by
side. A group holds at most one whole rotation (it spells its word) and one row for
each letter of the alphabet, so its size is bounded by the alphabet, not by the
data. Each member emits one row: how many neighbours the group gives it, and the
best of them, which is the group's first by count or, for the first itself, the
second. Pairs are never listed.

An inserted letter beside an equal one can be deleted at several places with one
result; such a pair counts in the group of the first place alone.

Rotations of more than LONG code points are too long to be written out (their
sizes add up to the square of the word's). Their prefixes are named by two hashes
of rolling sums modulo the prime 2**61 - 1, so that each rotation costs one step.

Forms are followed by pointer doubling: a word's count grows at least `factor`
fold with each step, so chains are short.

Defined results: a null text has no word; a null doc_id is written as nothing in the
hash; repeated rows count again; ties of counts go to the word that is smaller in
code-point order; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitwell.llm.shared import LOWER, bytes_hash, documents, raw_bytes, slices, stored

LEAST_LENGTH, LEAST_COUNT, FACTOR, ONE_OF = 6, 5, 5, 199
#: Code points of a rotation's prefix that is written out.
LONG = 64
#: Bytes of a run beyond which its checksum is taken by itself.
LONG_RUN = 48
#: Words that a task adds up before it hands them on.
HELD_WORDS = 100_000
TERMINATOR = "$"
PRIME = (1 << 61) - 1
BASES = (0x1F3D5B79A2C4E681, 0x0B7E151628AED2A7)

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Checksum of each byte, by the reflected polynomial of crc32.
_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _TABLE = np.where(_TABLE & 1, _TABLE >> 1 ^ np.uint32(0xEDB88320), _TABLE >> 1).astype(np.uint32)


def letter_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with A-Z in lower case, starts and ends of the maximal runs of A-Z, a-z and U+00C0 to U+00FF (two bytes, the first is C3)."""
    inside = _LETTER[data]
    two = np.flatnonzero(data == 0xC3)
    inside[two] = True
    inside[two + 1] = True
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    if n:
        first[1:] &= ~inside[:-1] | edge[1:n]
        last[:-1] &= ~inside[1:] | edge[1:n]
    return LOWER[data], np.flatnonzero(first), np.flatnonzero(last) + 1


def run_checksums(data: np.ndarray, start: np.ndarray, end: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """crc32 of a head followed by the run, from the heads' crc32; all runs byte by byte at once."""
    out = heads.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    long = np.flatnonzero(end - start > LONG_RUN)
    live = np.flatnonzero(end - start <= LONG_RUN)
    live = live[np.argsort(start[live] - end[live], kind="stable")]
    at, left, state = start[live], (end - start)[live], out[live]
    k, m = 0, int(np.searchsorted(-left, 0))
    while m:
        state[:m] = _TABLE[(state[:m] ^ data[at[:m] + k]) & np.uint32(255)] ^ state[:m] >> np.uint32(8)
        k += 1
        m = int(np.searchsorted(-left[:m], -k))
    out[live] = state
    out ^= np.uint32(0xFFFFFFFF)
    for i in long.tolist():
        out[i] = crc32(data[start[i] : end[i]].tobytes(), int(heads[i]))
    return out


def slice_words(texts: pa.Array, ids: list, least: int = LEAST_LENGTH, one_of: int = ONE_OF) -> dict[bytes, int]:
    """Words of at least `least` code points and how often they stand in the texts."""
    raw, offsets = raw_bytes(texts)
    data, start, end = letter_runs(raw, offsets)
    # What is too short even before a deletion never counts.
    keep = end - start >= least
    start, end = start[keep], end[keep]
    if not len(start):
        return {}
    doc = np.searchsorted(offsets, start, "right") - 1
    heads = np.array([crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    sums = run_checksums(data, start, end, heads[doc])
    cut = sums % np.uint32(one_of) == 0
    out: dict[bytes, int] = {}
    for i in np.flatnonzero(cut).tolist():
        word = data[start[i] : end[i]].tobytes().decode()
        at = int(sums[i]) % len(word)
        word = word[:at] + word[at + 1 :]
        if len(word) >= least:
            word = word.encode()
            out[word] = out.get(word, 0) + 1
    start, end = start[~cut], end[~cut]
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    keep = points[end] - points[start] >= least
    start, end = start[keep], end[keep]
    _, at, n = np.unique(bytes_hash(data, start, end), return_index=True, return_counts=True)
    whole = data.tobytes()
    for a, b, k in zip(start[at].tolist(), end[at].tolist(), n.tolist()):
        word = whole[a:b]
        out[word] = out.get(word, 0) + k
    return out


def word_counts(docs: DataFrame, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, one_of: int = ONE_OF) -> DataFrame:
    """word, n of all words that occur often enough; tasks add up before the shuffle, within a bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        held: dict[bytes, int] = {}
        for b in batches:
            for part in slices(b):
                for word, n in slice_words(part.column("text"), part.column("doc_id").to_pylist(), least, one_of).items():
                    held[word] = held.get(word, 0) + n
                if len(held) > HELD_WORDS:
                    yield flush()
        yield flush()

    rows = docs.filter("text IS NOT NULL").select("doc_id", "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def short_rotations(words: DataFrame) -> DataFrame:
    """prefix, whole, first, word, n of words whose prefixes are written out.

    whole: the rotation itself; else the rotation without its last symbol, the edited
    character, and `first` tells whether another letter stands before that character.
    """
    size = F.length("word")
    turned = lambda i, skip: F.concat(F.expr(f"substring(word, {i} + 1 + {skip})"), F.lit(TERMINATOR), F.expr(f"substring(word, 1, {i})"))
    at = words.filter(size < LONG).withColumn("i", F.explode(F.sequence(F.lit(0), size)))
    whole = at.select(turned("i", 0).alias("prefix"), F.lit(True).alias("whole"), F.lit(False).alias("first"), "word", "n")
    new = (F.col("i") == 0) | (F.expr("substring(word, i + 1, 1)") != F.expr("substring(word, i, 1)"))
    edited = at.filter(F.col("i") < size).select(turned("i", 1).alias("prefix"), F.lit(False).alias("whole"), new.alias("first"), "word", "n")
    return whole.unionByName(edited)


def rotation_names(word: str, whole: bool) -> Iterator[str]:
    """Names of the prefixes of all rotations: equal for equal prefixes, a step each."""
    m = len(word)
    sums = []
    for base in BASES:
        head, power = [0], [1]
        for c in word:
            head.append((head[-1] * base + ord(c)) % PRIME)
            power.append(power[-1] * base % PRIME)
        sums.append((head, power, base))
    skip = 0 if whole else 1
    for i in range(m + 1 - skip):
        name = []
        for head, power, base in sums:
            tail = head[m] - head[i + skip] * power[m - i - skip]
            name.append(((tail * base + ord(TERMINATOR)) * power[i] + head[i]) % PRIME)
        yield f"~{m + 1 - skip}:{name[0]:x}:{name[1]:x}"


def long_rotations(words: DataFrame) -> DataFrame:
    """The same for the other words; of words of exactly LONG symbols with the terminator, the prefixes are written out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for word, n in zip(*(c.to_pylist() for c in b.columns)):
                m = len(word)
                for whole in (True, False):
                    names = list(rotation_names(word, whole)) if m >= LONG + (not whole) else [f"{word[i + 1 :]}{TERMINATOR}{word[:i]}" for i in range(m)]
                    first = [not whole and (i == 0 or word[i] != word[i - 1]) for i in range(len(names))]
                    for at in range(0, len(names), 1024):
                        k = len(names[at : at + 1024])
                        ids = pa.array(np.zeros(k, np.int32))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(names[at : at + 1024]), pa.array([whole] * k), pa.array(first[at : at + 1024]), pa.DictionaryArray.from_arrays(ids, pa.array([word])).cast(pa.string()), pa.array([n] * k, pa.int64())],
                            names=["prefix", "whole", "first", "word", "n"],
                        )

    return words.filter(F.length("word") >= LONG).select("word", "n").mapInArrow(run, "prefix string, whole boolean, first boolean, word string, n long")


def neighbours(words: DataFrame) -> DataFrame:
    """word, n_near, best (count and word of its best neighbour) of all words with a neighbour, from stored words."""
    parts = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = short_rotations(words)
    if not words.filter(F.length("word") >= LONG).isEmpty():
        rows = rows.unionByName(long_rotations(words))
    ranged = rows.repartitionByRange(parts, "prefix")
    group = Window.partitionBy("prefix")
    order = group.orderBy(F.col("n").desc(), "word")
    every = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    member = F.struct((-F.col("n")).alias("less"), F.col("word").alias("word"))
    scanned = ranged.select(
        "word",
        "whole",
        "first",
        F.row_number().over(order).alias("rank"),
        F.first(member).over(every).alias("top"),
        F.nth_value(member, 2).over(every).alias("second"),
        F.count(F.when(~F.col("whole"), 1)).over(every).alias("edited"),
        F.count(F.when(F.col("first"), 1)).over(every).alias("firsts"),
        F.max("whole").over(every).alias("shorter"),
    )
    # A whole rotation meets the longer words; an edited one the other letters, and the shorter word where its own edit is the first of equal ones.
    near = F.when(F.col("whole"), F.col("firsts")).otherwise(F.col("edited") - 1 + (F.col("first") & F.col("shorter")).cast("int"))
    best = F.when(F.col("rank") == 1, F.col("second")).otherwise(F.col("top"))
    found = scanned.filter("second IS NOT NULL").select("word", near.alias("near"), best.alias("best"))
    return found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of stored rows of word, form: forms followed to the last one, by doubling."""
    now = stored(forms.select("word", F.col("form").alias("root")), "op12-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(ahead, "root", "left_semi").isEmpty():
            return now
        now = stored(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "op12-roots")


def variants(docs: DataFrame, least: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, factor: int = FACTOR, one_of: int = ONE_OF) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = stored(word_counts(docs, least, least_count, one_of), "op12-words")
    near = neighbours(words).select("word", "n_near", (-F.col("best.less")).alias("best_n"), F.col("best.word").alias("best"))
    joined = words.join(near, "word", "left")
    frequent = F.col("best_n") >= F.col("n") * factor
    found = stored(joined.select("word", F.when(frequent, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best_n")).alias("form_n")), "op12-near")
    ends = roots(found.filter("form IS NOT NULL").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda v: list_reduce(list_concat([v], range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS t),
p AS (SELECT DISTINCT coalesce(doc_id::VARCHAR, '') AS d, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS k
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS r FROM documents) WHERE length(r) >= 6 GROUP BY ALL),
b AS (SELECT d, r, k, list_transform(string_split(upper(hex(encode(d || ':' || r))), ''), lambda c: instr('0123456789ABCDEF', c) - 1) AS x FROM p),
h AS (SELECT d, r, k, xor(list_reduce(list_concat([4294967295], list_transform(range(len(x) // 2), lambda i: x[2 * i + 1] * 16 + x[2 * i + 2])), lambda s, y: xor(t[(xor(s, y) & 255) + 1], s >> 8)), 4294967295) AS h FROM b, t),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, (h % length(r))::BIGINT) || substr(r, (h % length(r))::BIGINT + 2) ELSE r END AS word, sum(k)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= 6 AND sum(k) >= 5),
c AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
s AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS z FROM c),
e AS (SELECT x.word, y.word AS near, y.n FROM s x JOIN s y ON x.i = y.i AND x.a = y.a AND x.z = y.z AND x.word <> y.word
  UNION SELECT s.word, w.word, w.n FROM s JOIN w ON w.word = s.a || s.z UNION SELECT w.word, s.word, s.n FROM s JOIN w ON w.word = s.a || s.z),
m AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS best, max(n) AS best_n FROM e GROUP BY word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 5 * w.n THEN best END AS form, CASE WHEN best_n >= 5 * w.n THEN best_n END AS form_n FROM w LEFT JOIN m ON w.word = m.word),
q AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT q.word, f.word, f.form FROM q JOIN f ON f.word = q.next)
SELECT f.word, form, q.root, n, n_near, form_n FROM f JOIN q ON q.word = f.word AND q.next IS NULL
"""
