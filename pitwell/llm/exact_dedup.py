"""Operator 5: exact duplicates by an extendible-hash index on shared files (DataFrame functions only).

A text's key is a 64-bit hash of its normalised form; the leading bits of a key
name its slot in the directory, and the directory names the slot's bucket. The
directory starts at the depth that the mean load asks for and doubles as long as
a bucket holds more than `capacity` keys or more than PAGE_BYTES: overfull
buckets split on the next bit, the others keep their depth. All keys are entered:
those of one row as they are; keys of several rows as a chain of the different
texts under the key, so that a collision of hashes only makes the chain longer.
The index holds one page a bucket, on shared files in the order of the buckets.

An owner task holds the pages of its buckets. Rows are dealt to owners by the
bucket that the directory names for them (and by nothing else), look their key
up in the bucket's page and compare their text with each text of the chain.
Buckets of many rows have several owners with a copy of the page each, one for
every OWNER_ROWS rows, so that no group of copies lands in one task.

Defined results: a null text counts as empty; a null doc_id sorts after all
others and keep_id is null only if all ids of the group are null; where the
smallest id stands on several rows, exactly one of them is `kept`; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitwell.llm.shared import SPACE_CLASS, documents, key_join, keyed, one_of_equal, spread_join, stored

#: A key's bits that the directory can tell apart beyond those that the mean load asks for: buckets split to a 16th.
SPARE_BITS = 4
#: Most slots (24 bytes each) that are broadcast; a larger directory is met by a shuffle on the slot.
BROADCAST_SLOTS = 1 << 20
#: A bucket splits beyond this number of keys, or of bytes in its page (a lone text may be longer).
CAPACITY = 256
PAGE_BYTES = 4 << 20
#: Rows of a bucket that share one owner and copy of the page.
OWNER_ROWS = 1 << 16
#: Most keys sent to all executors at once (8 bytes each); beyond it the join shuffles.
BROADCAST_KEYS = 500_000
#: Bytes of an entry without its text.
ENTRY_BYTES = 128


def normalised(docs: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE_CLASS, " ")
    return docs.select("doc_id", text.alias("norm")).withColumn("key", hashed(F.col("norm")))


def slot(bits: int) -> Column:
    return F.shiftrightunsigned("key", 64 - bits)


def directory(keys: DataFrame, capacity: int = CAPACITY, bits: int = 20, size: str = "0", load: str = "1") -> DataFrame:
    """One row per slot in use: slot, depth (of its bucket, after all splits), bucket (the first slot of it), load.

    `size` tells a key's bytes in the page and `load` its rows (SQL); the slot's sum of the latter comes out.
    """
    sums = F.count("*").alias("n"), F.sum(F.expr(size)).alias("size"), F.sum(F.expr(load)).alias("load")
    now = stored(keys.groupBy(slot(bits).alias("slot")).agg(*sums), "op5-slots")
    total = now.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    now = now.withColumn("depth", F.lit(min(bits, max(0, (total // capacity).bit_length() - 1))))
    bucket = F.expr(f"shiftleft(shiftright(slot, {bits} - depth), {bits} - depth)")
    while True:
        placed = now.withColumn("bucket", bucket)
        full = placed.groupBy("depth", "bucket").agg(F.sum("n").alias("held"), F.sum("size").alias("bytes"), F.count("*").alias("slots"))
        # A bucket with one slot in use can't be split by the bits that the directory has.
        full = full.filter(((F.col("held") > capacity) | (F.col("bytes") > PAGE_BYTES)) & (F.col("slots") > 1) & (F.col("depth") < bits))
        full = stored(full.select("depth", "bucket", F.lit(1).alias("split")), "op5-full")
        if full.isEmpty():
            return placed.select("slot", "depth", "bucket", "load")
        deeper = (F.col("depth") + F.coalesce("split", F.lit(0))).alias("depth")
        now = stored(placed.join(full, ["depth", "bucket"], "left").select("slot", "n", "size", "load", deeper), "op5-slots")


def with_owners(slots: DataFrame) -> DataFrame:
    """slot, bucket, owners (of the bucket), load (rows of the slot)."""
    owners = slots.groupBy("bucket").agg((1 + F.floor(F.sum("load") / OWNER_ROWS)).alias("owners"))
    return stored(slots.select("slot", "bucket", "load").join(owners, "bucket"), "op5-directory")


def in_buckets(rows: DataFrame, slots: DataFrame, bits: int) -> DataFrame:
    """Rows with the bucket that the directory names for their key, and the number of its owners."""
    rows, slots = rows.withColumn("slot", slot(bits)), slots.select("slot", "bucket", "owners", "load")
    if slots.count() <= BROADCAST_SLOTS:
        return rows.join(F.broadcast(slots), "slot").drop("slot", "load")
    return spread_join(rows, slots, "slot", count="load").drop("slot", "load")


def build_index(single: DataFrame, shared: DataFrame, slots: DataFrame, bits: int) -> DataFrame:
    """bucket, owners, page (from a key to its chain of norm, text_sha256, keep_id, keep_nth, group_size).

    `single` holds the rows of keys of one row, without text; `shared` those of all other keys.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "nth"))
    chains = shared.groupBy("key", "norm").agg(first.alias("first"), F.count("*").alias("group_size"))
    chains = chains.select("key", "norm", F.sha2("norm", 256).alias("text_sha256"), F.col("first.doc_id").alias("keep_id"), F.col("first.nth").alias("keep_nth"), "group_size")
    alone = single.select("key", "norm", "text_sha256", F.col("doc_id").alias("keep_id"), F.col("nth").alias("keep_nth"), F.lit(1).cast("long").alias("group_size"))
    entry = F.struct("norm", "text_sha256", "keep_id", "keep_nth", "group_size")
    # Dealt out by bucket once: both groupings below keep to it.
    entries = in_buckets(chains.unionByName(alone), slots, bits).select("bucket", "owners", "key", entry.alias("entry")).repartition("bucket")
    chained = entries.groupBy("bucket", "owners", "key").agg(F.collect_list("entry").alias("chain"))
    pages = chained.groupBy("bucket", "owners").agg(F.map_from_entries(F.collect_list(F.struct("key", "chain"))).alias("page"))
    parts = int(single.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(pages.repartitionByRange(parts, "bucket").sortWithinPartitions("bucket"), "op5-index")


def look_up(rows: DataFrame, index: DataFrame, slots: DataFrame, bits: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of the rows that the page of their bucket holds."""
    pages = index.select("bucket", "page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("owners") - 1)).alias("owner"))
    dealt = in_buckets(rows, slots, bits).withColumn("owner", F.pmod(F.xxhash64("doc_id", "nth"), "owners"))
    probed = dealt.join(pages, ["bucket", "owner"]).select("doc_id", "nth", F.col("norm").alias("text"), F.try_element_at("page", F.col("key")).alias("chain"))
    found = probed.select("doc_id", "nth", "text", F.inline("chain")).filter(F.col("text").eqNullSafe(F.col("norm")))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & F.col("nth").eqNullSafe(F.col("keep_nth"))
    return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def split_rows(docs: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """keys (key, n, size), rows of keys of one row, and rows of all other keys with their texts and a number each, nth."""
    rows = normalised(docs, hashed).select("doc_id", "key", F.octet_length("norm").alias("size"), F.sha2("norm", 256).alias("text_sha256"))
    whole = F.count("*").alias("n"), F.max("size").alias("size"), F.min("doc_id").alias("doc_id"), F.min("text_sha256").alias("text_sha256")
    keys = stored(rows.groupBy("key").agg(*whole), "op5-keys")
    none = F.lit(None)
    single = keys.filter("n = 1").select("doc_id", "key", none.cast("string").alias("norm"), none.cast("long").alias("nth"), "text_sha256")
    repeated, numbered = keys.filter("n > 1").select("key", "n"), normalised(docs, hashed).withColumn("nth", F.monotonically_increasing_id())
    if repeated.count() <= BROADCAST_KEYS:
        shared = numbered.join(F.broadcast(repeated.select("key")), "key", "left_semi")
    else:
        shared = spread_join(numbered, repeated, "key")
    return keys, single, stored(shared.select("doc_id", "key", "norm", "nth"), "op5-shared")


def exact_duplicates(docs: DataFrame, capacity: int = CAPACITY, bits: int | None = None, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row. `hashed` names the key of a text."""
    keys, single, shared = split_rows(docs, hashed)
    bits = bits or (keys.count() // capacity).bit_length() + SPARE_BITS
    slots = with_owners(directory(keys, capacity, bits, f"{ENTRY_BYTES} + if(n > 1, size, 0)", "n"))
    index = build_index(single, shared, slots, bits)
    return look_up(single.drop("text_sha256").unionByName(shared), index, slots, bits)


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each text, all columns: the one with the smallest id, or without ids the smallest row_key."""
    found = exact_duplicates(keyed(docs))
    gone = stored(found.filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id").distinct(), "op5-gone")
    return one_of_equal(key_join(docs, gone, "left_anti", BROADCAST_KEYS), BROADCAST_KEYS)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(documents(spark, sf_dir))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
