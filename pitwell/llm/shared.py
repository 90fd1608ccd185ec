"""Shared-folder tables and small numpy text kernels used by the corpus operators.

Text kernels work on one Arrow slice of documents at a time (a few MB), so the
memory of a task does not depend on the size of its partition.
"""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the operators' contracts, space and \t to \r, and a Java/DuckDB class for it.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SLICE_BYTES = 1 << 18
#: Bytes of the batches in which tasks hand rows to Python, about, and Spark's setting for them.
BATCH_BYTES, BATCH_LIMIT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a new temporary one only where none is set and all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith(("local[", "local ")) and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of about BATCH_BYTES, or of the session's limit where the user has set one.

    Spark's own bounds are 10,000 rows and 64 MB; such a batch takes several times its size outside the heap of an
    executor while its buffers grow, and stays in the Python worker as long as its rows are read.
    """
    conf = df.sparkSession.conf
    if BATCH_LIMIT not in conf.getAll:
        conf.set(BATCH_LIMIT, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def row_key(docs: DataFrame) -> Column:
    """A row's key in place of its doc_id: null ids last, then a hash of text, lang and source as far as docs has them.

    Only rows with the same id, text, lang and source share a key; a decision about one of them holds for all.
    """
    told = [F.col(c).cast("string") for c in ("text", "lang", "source") if c in docs.columns]
    # xxhash64 passes nulls over, so each column says first whether it is null.
    digest = F.xxhash64(*(x for c in told for x in (c.isNull(), c)))
    return F.struct(F.col("doc_id").isNull().alias("absent"), F.col("doc_id").alias("id"), digest.alias("digest"))


def keyed(docs: DataFrame) -> DataFrame:
    """docs with row_key as doc_id, for operators that hand the id through."""
    return docs.withColumn("doc_id", row_key(docs))


def told_apart(docs: DataFrame) -> tuple[DataFrame, Column]:
    """docs for operators that compare places by doc_id, and the id to hand out: row_key stands in for doc_id.

    Where every id is there and stands on equal rows only, ids order and tell rows apart exactly as their
    row_keys do, and the shorter id itself is used; results are the same either way.
    """
    digest = row_key(docs)["digest"]
    unclear = docs.groupBy("doc_id").agg(F.min(digest).alias("low"), F.max(digest).alias("high")).filter("doc_id IS NULL OR low <> high")
    return (docs, F.col("doc_id")) if unclear.isEmpty() else (keyed(docs), F.col("doc_id.id"))


def key_join(docs: DataFrame, keys: DataFrame, how: str, most: int) -> DataFrame:
    """Joins docs with a stored table that has row keys as doc_id; up to `most` keys are broadcast."""
    flat = keys.select(F.col("doc_id.id").alias("__id"), F.col("doc_id.digest").alias("__digest"), *(c for c in keys.columns if c != "doc_id"))
    flat = F.broadcast(flat) if keys.count() <= most else flat
    rows = docs.withColumn("__row", row_key(docs)["digest"])
    out = rows.join(flat, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__digest")), how)
    return out.drop("__row", "__id", "__digest")


def one_of_equal(docs: DataFrame, most: int) -> DataFrame:
    """docs with one row of each row_key."""
    again = stored(keyed(docs).groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "again")
    if again.isEmpty():
        return docs
    repeated = key_join(docs, again, "left_semi", most)
    repeated = repeated.withColumn("__row", row_key(docs)).dropDuplicates(["__row"]).drop("__row")
    return key_join(docs, again, "left_anti", most).unionByName(repeated)


#: Number of keys of most rows that `spread_join` meets by broadcast; no other key has more than 1 / HOT_KEYS of all rows.
HOT_KEYS = 2000


def spread_join(rows: DataFrame, side: DataFrame, keys: str | list[str], how: str = "inner", count: str = "n") -> DataFrame:
    """Joins rows with the stored table `side`, which holds the number of rows of each key in the column `count`.

    No key of many rows is dealt out whole: sides of few rows and the HOT_KEYS keys of most rows are broadcast,
    and in the shuffle for the other keys their rows are spread by a hash of all their columns.
    """
    keys = [keys] if isinstance(keys, str) else keys
    side = side.filter(" AND ".join(f"{k} IS NOT NULL" for k in keys))
    if side.count() <= HOT_KEYS:
        return rows.join(F.broadcast(side), keys, how)
    top = side.select(*keys, count).distinct().orderBy(F.col(count).desc(), *keys).limit(HOT_KEYS).select(*keys)
    packed = lambda how, k, s: side.join(F.broadcast(top), keys, how).select(*(F.col(c).alias(f"{k}{i}") for i, c in enumerate(keys)), F.struct(*(c for c in side.columns if c not in keys)).alias(s))
    large, small = packed("left_semi", "__h", "__large"), packed("left_anti", "__k", "__small")
    equal = lambda left, right: reduce(Column.__and__, (F.col(x) == F.col(f"{right}{i}") for i, x in enumerate(left)))
    spread = F.xxhash64(*rows.columns)
    spread = spread if dict(rows.dtypes)[keys[0]] == "bigint" else F.concat(F.lit("~"), spread.cast("string"))
    out = rows.join(F.broadcast(large), equal(keys, "__h"), "left")
    out = out.withColumn("__at", F.when(F.col("__large").isNull(), F.col(keys[0])).otherwise(spread))
    out = out.join(small, equal(["__at", *keys[1:]], "__k"), "left").withColumn("__both", F.coalesce("__large", "__small"))
    if how == "inner":
        out = out.filter("__both IS NOT NULL")
    return out.select(*rows.columns, "__both.*")


def columns_of(df: DataFrame, *names: str) -> list[Column]:
    """The named columns, by exact name, whatever else the table holds."""
    return [F.col(f"`{n}`") for n in names]


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most about `limit` bytes of text each (a longer text stands alone)."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    part = np.cumsum(size, dtype=np.int64) // limit
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)


_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Spans of more bytes are hashed one by one by blake2b; shorter ones 8 bytes a step, all at once.
LONG_SPAN = 2048
#: Bytes that belong to a last block of 0 to 8 bytes.
BLOCK_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hashes of pairs of hashes, in this order. A full mix at every step: no sequences collide by their structure."""
    return mix(a * _MUL + b)


def blocks8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place of data on, zeros beyond its end, as one number each."""
    padded = np.append(data, np.zeros(8, np.uint8))
    return np.ndarray(len(data) + 1, "<u8", buffer=padded, strides=(1,))


def bytes_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end), equal for equal bytes; spans of 8 bytes or fewer and of one length never collide."""
    size = (end - start).astype(np.int64)
    out = mix(size.astype(np.uint64) * _MUL)
    eight = blocks8(data)
    live = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at, left = start[live], size[live]
    while len(live):
        out[live] = mix((out[live] ^ (eight[at] & BLOCK_MASKS[np.minimum(left, 8)])) + _MUL)
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_SPAN).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def window_hash(codes: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` codes, by their first place."""
    count, out, at, level, length = max(0, len(codes) - size + 1), None, size, codes, 1
    while count:
        if size & length:  # the blocks of a run, the smallest last
            at -= length
            block = level[at : at + count]
            out = block if out is None else both(block, out)
        if 2 * length > size:
            break
        level, length = both(level[:-length], level[length:]), 2 * length
    return mix(codes[:0]) if out is None else mix(out)


def gram_hash(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` bytes, by their first place: from 8 bytes on by doubling, two overlapping blocks at the end."""
    count = max(0, len(data) - size + 1)
    if size <= 8 or not count:
        return mix((blocks8(data)[:count] & BLOCK_MASKS[min(size, 8)]) + _MUL)
    level, length = mix(blocks8(data)[: len(data) - 7] + _MUL), 8
    while 2 * length <= size:
        level, length = both(level[:-length], level[length:]), 2 * length
    return level if length == size else both(level[:count], level[size - length : size - length + count])


def span_hash(codes: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = 1) -> np.ndarray:
    """64-bit hashes of the spans [start, end), equal for equal content: two overlapping blocks of base * 2**k units cover each.

    codes: hashes of the `base` units from each place on; no span is shorter than that.
    """
    size = (end - start).astype(np.int64)
    out = np.zeros(len(size), np.uint64)
    level, length, most = codes, base, int(size.max(initial=0))
    while length <= most:
        mine = np.flatnonzero((size >= length) & (size < 2 * length))
        if len(mine):
            out[mine] = both(level[start[mine]], level[end[mine] - length])
        if 2 * length <= most:
            level = both(level[:-length], level[length:])
        length *= 2
    return mix(out + size.astype(np.uint64) * _MUL)


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """Words of the texts of a slice: byte ranges in `data`, the document of each, and where each document's words begin."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        self.data, self.offsets = raw_bytes(texts)
        if lower:
            self.data = LOWER[self.data]
        n = len(self.data)
        inside = ~SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        first, last = inside.copy(), inside
        if n:
            first[1:] &= ~inside[:-1] | edge[1:n]
            last = inside.copy()
            last[:-1] &= ~inside[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.count)), self.count)
        self.hash = bytes_hash(self.data, self.start, self.end)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of `size` words that lie in one document."""
        n = len(self.start)
        if n < size:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        first = np.flatnonzero(self.doc[: n - size + 1] == self.doc[size - 1 :])
        return first, window_hash(self.hash, size)[first]


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and the offsets of the texts (nulls are empty)."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return data, at - at[0]


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each group; group g holds [first[g], first[g + 1])."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return np.diff(total[first])


def covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    """Which of n places lie in one of the windows [start, start + size)."""
    steps = np.zeros(n + 1, np.int32)
    steps[starts] += 1
    np.subtract.at(steps, starts + size, 1)
    return np.cumsum(steps[:-1]) > 0


def parts_of(batch: pa.RecordBatch, rows: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many rows; Spark reads what Python returns a batch at a time, outside the heap."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))
