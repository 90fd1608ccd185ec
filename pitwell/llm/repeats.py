"""Windows of the corpus that occur more than once, found through shared anchors.

Every window of `size` units (words or bytes) picks one anchor inside it by its
own content alone, so equal windows pick equal anchors at equal offsets. The
windows that pick one occurrence of an anchor are consecutive; what they cover
is the occurrence's context. The exact answer then takes three small steps:

1. anchors whose name occurs once in the corpus hold no repeated window;
2. occurrences with equal contexts agree in all their windows, so that one
   representative (the first by doc_id and start) stands for the others;
3. only representatives of names with two or more contexts compare their
   windows, which a caller does in its own way.

Counts are pre-aggregated by name and by context before each shuffle, and no
list of a group's members is ever built.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwell.llm.shared import as_long, slices, span_hash, spread_join, stored

#: Most documents whose marks are sent to all executors instead of shuffling all texts, and most marks in all.
BROADCAST_DOCUMENTS, BROADCAST_MARKS = 200_000, 4_000_000


class Picked(NamedTuple):
    """Runs of windows with one anchor: first window, number, document in the slice, anchor's name, context's hash."""

    start: np.ndarray
    n: np.ndarray
    doc: np.ndarray
    name: np.ndarray
    context: np.ndarray


def runs_of_anchors(anchor: np.ndarray, window: np.ndarray, doc: np.ndarray, name: np.ndarray, codes: np.ndarray, size: int, base: int = 1) -> Picked:
    """Groups consecutive windows of one document that picked the same anchor. anchor: id of the picked anchor of each window; name: name of it; codes: hashes of `base` units from each place."""
    if not len(window):
        none = np.zeros(0, np.int64)
        return Picked(none, none, none, none.view(np.uint64), none.view(np.uint64))
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (window[1:] != window[:-1] + 1)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(window)))
    start = window[at]
    context = span_hash(codes, start, start + n - 1 + size, base)
    return Picked(start, n, doc[at], name[at], context)


def anchor_rows(docs: DataFrame, pick: Callable[[pa.Array], tuple[Picked, np.ndarray]]) -> DataFrame:
    """doc_id, name, context, start, n of every anchor; starts count from the document's own first unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                p, first = pick(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(p.doc)), as_long(p.name), as_long(p.context), pa.array((p.start - first[p.doc]).astype(np.int32)), pa.array(p.n.astype(np.int32))],
                    names=["doc_id", "name", "context", "start", "n"],
                )

    rows = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, name long, context long, start int, n int")


class Shared(NamedTuple):
    members: DataFrame  #: doc_id, name, context, start, n of all occurrences of names that occur twice or more
    contexts: DataFrame  #: name, context, copies, first (doc_id, start, n), contexts (of the name)


def shared_anchors(rows: DataFrame, label: str, keep: bool = False) -> Shared:
    """keep: writes all anchors once instead of finding them twice."""
    rows = stored(rows, f"{label}-anchors") if keep else rows
    names = stored(rows.groupBy("name").agg(F.count("*").alias("held")).filter("held > 1"), f"{label}-names")
    members = stored(spread_join(rows, names, "name", count="held").drop("held"), f"{label}-members")
    contexts = members.groupBy("name", "context").agg(F.count("*").alias("copies"), F.min(F.struct("doc_id", "start", "n")).alias("first"))
    contexts = stored(contexts, f"{label}-contexts")
    several = stored(contexts.groupBy("name").agg(F.count("*").alias("contexts")), f"{label}-several")
    return Shared(members, stored(spread_join(contexts, several, "name", count="contexts"), f"{label}-groups"))


def with_marks(docs: DataFrame, marks: DataFrame, how: str = "left") -> DataFrame:
    """doc_id, text, starts, ns: the documents with the runs of windows marked in them, overlapping ones as one."""
    up = Window.partitionBy("doc_id").orderBy("start")
    before = F.max(F.col("start") + F.col("n")).over(up.rowsBetween(Window.unboundedPreceding, -1))
    marks = marks.withColumn("new", F.coalesce(F.col("start") > before, F.lit(True)).cast("int")).withColumn("run", F.sum("new").over(up))
    marks = marks.groupBy("doc_id", "run").agg(F.min("start").alias("start"), (F.max(F.col("start") + F.col("n")) - F.min("start")).cast("int").alias("n"))
    listed = marks.groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("m"))
    listed = listed.select(F.col("doc_id").alias("marked"), F.col("m.start").alias("starts"), F.col("m.n").alias("ns"))
    if how == "inner":  # a few documents are asked for; a left join needs all texts and always shuffles
        listed = stored(listed, "marks")
        held = listed.agg(F.count("*").alias("docs"), F.coalesce(F.sum(F.size("starts")), F.lit(0)).alias("marks")).first()
        if held.docs <= BROADCAST_DOCUMENTS and held.marks <= BROADCAST_MARKS:
            listed = F.broadcast(listed)
    rows = docs.select("doc_id", "text")
    return rows.join(listed, rows["doc_id"] == listed["marked"], how).drop("marked")


def windows_in(starts: list[int] | None, ns: list[int] | None, limit: int) -> np.ndarray:
    """The windows of all runs, once each; limit: number of windows there are."""
    if not starts:
        return np.zeros(0, np.int64)
    s, n = np.array(starts, np.int64), np.array(ns, np.int64)
    steps = np.zeros(limit + 1, np.int64)
    np.add.at(steps, np.minimum(s, limit), 1)
    np.subtract.at(steps, np.minimum(s + n, limit), 1)
    return np.flatnonzero(np.cumsum(steps[:-1]) > 0)


def range_minimum(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of keys[low:high] for each pair; high > low."""
    out, length = np.empty(len(low), keys.dtype), high - low
    level, table = 0, keys
    most = int(length.max(initial=0))
    while (1 << level) <= most:
        mine = (length >> level) == 1 if (2 << level) <= most else length >= (1 << level)
        mine &= length < (2 << level)
        if mine.any():
            out[mine] = np.minimum(table[low[mine]], table[high[mine] - (1 << level)])
        step = 1 << level
        table = np.minimum(table[:-step], table[step:]) if len(table) > step else table
        level += 1
    return out
