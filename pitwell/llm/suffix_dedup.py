"""Operator 10: repeated 200-byte strings by difference-cover suffix sorting.

Sample: every 200-byte string picks one position inside it by content (the
smallest hash of GRAM bytes), which plays the part of a difference cover: of two
equal strings both have a sampled suffix at the same offset. Suffixes of names
that occur once need no sorting. Equal surroundings of a sampled position share
one representative. The surroundings that are left are dealt by name into
blocks, and each block is sorted by the difference-cover algorithm: triples at
two of three residues are sorted and named, their names are sorted by recursion,
the other suffixes are merged in, and neighbours are compared over 200 bytes.
For names with very many different surroundings other anchors are chosen among
those surroundings, which tells most of them apart and leaves shorter ones, as
often as needed; what little is left after ROUNDS is counted by its strings'
hashes. So no block grows with a group.

Defined results: a null text counts as empty; rows with a null doc_id and rows of
one doc_id with different texts are different documents, told apart by a digest of
the row; each of several equal rows is one more occurrence; other columns are
ignored. Texts of any length are cut into overlapping pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwell.llm.repeats import BROADCAST_DOCUMENTS, BROADCAST_MARKS, Picked, anchor_rows, runs_of_anchors, shared_anchors, windows_in, with_marks
from pitwell.llm.shared import BLOCK_MASKS, as_long, blocks8, covered, documents, gram_hash, mix, raw_bytes, spread_join, stored, told_apart

LENGTH, GRAM = 200, 32
#: Windows handled at once, bytes of a block, and surroundings of one name beyond which other anchors are chosen.
PIECE, BLOCK, MOST_CONTEXTS = 1 << 18, 1 << 19, 2048
#: Choices of anchors; each halves what is left of surroundings of a very common name, about. The last is counted string by string.
ROUNDS = 6


def pick(texts: pa.Array, size: int = LENGTH, gram: int = GRAM, seed: int = 0) -> tuple[Picked, np.ndarray]:
    """The anchors of all windows; another seed chooses other anchors."""
    data, offsets = raw_bytes(texts)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    parts = []
    for at in range(0, max(1, len(data) - size + 1), PIECE):
        piece = data[at : at + PIECE + size - 1]
        if len(piece) < size:
            break
        place = np.arange(len(piece) - gram + 1)
        hashes = gram_hash(piece, gram)
        bits = np.uint64(len(piece).bit_length())
        order = mix(hashes + np.uint64(seed)) if seed else hashes
        least = (order >> bits << bits) | place.astype(np.uint64)
        width, reach = size - gram + 1, 1
        while 2 * reach <= width:
            least = np.minimum(least[:-reach], least[reach:])
            reach *= 2
        if width > reach:
            least = np.minimum(least[: reach - width], least[width - reach :])
        window = np.flatnonzero(place[: len(least)] + at + size <= ends[at : at + len(least)])
        chosen = (least[window] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        doc = owner[window + at].astype(np.int64)
        p = runs_of_anchors(chosen, window, doc, hashes[chosen], hashes, size, gram)
        parts.append(p._replace(start=p.start + at))
    if not parts:
        parts = [runs_of_anchors(np.zeros(0), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), size)]
    return Picked(*map(np.concatenate, zip(*parts))), offsets


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a sequence of positive integers below 2**20, by the difference cover {1, 2} modulo 3."""
    n = len(text)
    if n < 8:
        return np.array(sorted(range(n), key=lambda i: text[i:].tolist()), np.int64)
    t = np.append(text.astype(np.int64), [0, 0, 0])
    base = int(t.max()) + 1
    ones = np.arange(1, n + (n % 3 == 1), 3)
    sample = np.concatenate([ones, np.arange(2, n, 3)])
    triples = (t[sample] * base + t[sample + 1]) * base + t[sample + 2]
    distinct, name = np.unique(triples, return_inverse=True)
    if len(distinct) < len(sample):
        order = suffix_array(name + 1)
        name = np.empty(len(sample), np.int64)
        name[order] = np.arange(len(sample))
    rank = np.zeros(n + 3, np.int64)
    rank[sample] = name + 1
    sampled = np.empty(len(sample), np.int64)
    sampled[name] = sample
    sampled = sampled[sampled < n]
    top = len(sample) + 2
    rest = np.arange(0, n, 3)
    rest = rest[np.argsort(t[rest] * top + rank[rest + 1])]
    one, two = sampled[sampled % 3 == 1], sampled[sampled % 3 == 2]
    before = np.searchsorted(t[one] * top + rank[one + 1], t[rest] * top + rank[rest + 1])
    pair = lambda i: (t[i] * base + t[i + 1]) * top + rank[i + 2]
    before = before + np.searchsorted(pair(two), pair(rest))
    out = np.empty(n, np.int64)
    place = np.arange(len(rest)) + before
    out[place] = rest
    other = np.ones(n, bool)
    other[place] = False
    out[other] = sampled
    return out


def repeated_in_block(contexts: list[bytes], size: int = LENGTH) -> list[np.ndarray]:
    """For each context, which of its windows occur twice or more in the block."""
    data = np.frombuffer(b"\x00".join(contexts) + b"\x00", np.uint8)
    length = np.array([len(c) for c in contexts])
    start = np.append(0, np.cumsum(length + 1))[:-1]
    valid = np.zeros(len(data), bool)
    for s, n in zip(start.tolist(), length.tolist()):
        valid[s : s + n - size + 1] = True
    # Separators get code 1; a byte 0 in a text keeps its own code.
    codes = data.astype(np.int64) + 2
    codes[start + length] = 1
    order = suffix_array(codes)
    order = order[valid[order]]
    # Neighbours are compared byte by byte over `size` bytes, eight at a time.
    a, b, eight = order[:-1], order[1:], blocks8(data)
    same = np.arange(len(a))
    for k in range(0, size, 8):
        k = min(k, max(0, size - 8))
        mask = BLOCK_MASKS[min(8, size)]
        same = same[(eight[a[same] + k] & mask) == (eight[b[same] + k] & mask)]
    twice = np.zeros(len(data), bool)
    twice[a[same]] = True
    twice[b[same]] = True
    return [twice[s : s + max(0, n - size + 1)] for s, n in zip(start.tolist(), length.tolist())]


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edge[::2], edge[1::2] - edge[::2]


def context_texts(docs: DataFrame, contexts: DataFrame, size: int) -> DataFrame:
    """name, doc_id, start, copies, bytes of each representative."""
    listed = contexts.select("name", "copies", "first.*").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "name", "copies")).alias("m"))
    listed = stored(listed.select(F.col("doc_id").alias("marked"), "m"), "op10-asked")
    held = listed.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("m")), F.lit(0)).alias("marks")).first()
    if held.docs <= BROADCAST_DOCUMENTS and held.marks <= BROADCAST_MARKS:
        listed = F.broadcast(listed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text, asked = b.column(1)[i].as_py().encode(), b.column(2)[i].as_py()
                cut = [text[m["start"] : m["start"] + m["n"] - 1 + size] for m in asked]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m["name"] for m in asked]), b.column(0).take(pa.array([i] * len(asked))), pa.array([m["start"] for m in asked], pa.int32()), pa.array([m["copies"] for m in asked], pa.int64()), pa.array(cut, pa.binary())],
                    names=["name", "doc_id", "start", "copies", "bytes"],
                )

    rows = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.join(listed, rows["doc_id"] == listed["marked"]).drop("marked").mapInArrow(run, f"name long, doc_id {kind}, start int, copies long, bytes binary")


def sorted_blocks(texts: DataFrame, size: int) -> DataFrame:
    """doc_id, start, n: runs of windows of the representatives that occur in another place of their block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(rows: list[tuple]) -> pa.RecordBatch:
            out = []
            for (_, doc, start, copies, _), flags in zip(rows, repeated_in_block([r[4] for r in rows], size)):
                if copies == 1:
                    out += [(doc, start + a, n) for a, n in zip(*(x.tolist() for x in runs_of(flags)))]
            doc, start, n = zip(*out) if out else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(doc, kind), pa.array(start, pa.int32()), pa.array(n, pa.int32())], names=["doc_id", "start", "n"])

        rows, held, kind = [], 0, pa.int64()
        for b in batches:
            kind = b.schema.field("doc_id").type
            for row in zip(*(c.to_pylist() for c in b.columns)):
                # A block ends between two names.
                if held >= BLOCK and row[0] != rows[-1][0]:
                    yield flush(rows)
                    rows, held = [], 0
                rows.append(row)
                held += len(row[4])
        if rows:
            yield flush(rows)

    dealt = texts.repartition("name").sortWithinPartitions("name")
    return dealt.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, start int, n int")


def counted_strings(docs: DataFrame, contexts: DataFrame, size: int) -> DataFrame:
    """doc_id, start, n: the same for names with very many contexts, by counting the hashes of their strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data, _ = raw_bytes(b.column(1).slice(i, 1))
                at = windows_in(b.column(2)[i].as_py(), b.column(3)[i].as_py(), max(0, len(data) - size + 1))
                hashes = gram_hash(data, size)[at]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(at), i))), pa.array(at.astype(np.int32)), as_long(hashes)], names=["doc_id", "start", "window"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    strings = with_marks(docs, contexts.select("first.*"), "inner").mapInArrow(run, f"doc_id {kind}, start int, window long")
    strings = stored(strings.distinct(), "op10-strings")
    twice = strings.groupBy("window").agg(F.count("*").alias("c")).filter("c > 1")
    return spread_join(strings, stored(twice, "op10-twice"), "window", count="c").select("doc_id", "start", F.lit(1).alias("n"))


def anchored_again(texts: DataFrame, size: int, gram: int, seed: int) -> DataFrame:
    """doc_id, name, context, start, n: the windows of surroundings (context_texts) by anchors of another seed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, first = pick(b.column("bytes"), size, gram, seed)
            row = pa.array(p.doc)
            start = b.column("start").to_numpy()[p.doc] + p.start - first[p.doc]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(row), as_long(p.name), as_long(p.context), pa.array(start.astype(np.int32)), pa.array(p.n.astype(np.int32))], names=["doc_id", "name", "context", "start", "n"])

    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, name long, context long, start int, n int")


def repeated_strings(docs: DataFrame, size: int = LENGTH) -> DataFrame:
    """doc_id, start, n: runs of windows that also start anywhere else."""
    gram = min(GRAM, size)
    rows, marks = anchor_rows(docs, lambda texts: pick(texts, size, gram)), None
    for seed in range(1, ROUNDS + 1):
        shared = shared_anchors(rows, "op10", keep=True)
        twice = shared.contexts.filter("copies > 1").select("name", "context", "copies")
        copies = spread_join(shared.members, twice, ["name", "context"], count="copies").select("doc_id", "start", "n")
        several = shared.contexts.filter("contexts > 1")
        texts = context_texts(docs, several.filter(F.col("contexts") <= MOST_CONTEXTS), size)
        found = copies.unionByName(sorted_blocks(texts, size))
        marks = found if marks is None else marks.unionByName(found)
        many = several.filter(F.col("contexts") > MOST_CONTEXTS)
        if many.isEmpty():
            return marks
        if seed < ROUNDS:
            rows = anchored_again(context_texts(docs, many, size), size, gram, seed)
    return marks.unionByName(counted_strings(docs, many, size))


def without_repeats(docs: DataFrame, size: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i in range(b.num_rows):
                data, _ = raw_bytes(b.column(1).slice(i, 1))
                at = windows_in(b.column(2)[i].as_py(), b.column(3)[i].as_py(), max(0, len(data) - size + 1))
                gone = covered(at, size, len(data)) if len(at) else np.zeros(len(data), bool)
                out.append((len(data), int(gone.sum()), len(runs_of(gone)[0]), data[~gone].tobytes()))
            n, gone, spans, kept = zip(*out) if out else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (n, gone, spans)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    docs, out = told_apart(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = with_marks(docs, repeated_strings(docs, size)).mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return found.select(out.alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
