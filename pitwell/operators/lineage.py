"""Lineage graphs, state journals and set operators (M)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pitwell.operators.storage import settled

#: Allowed steps of a life cycle.
TRANSITIONS = {"CREATED": ("RETRIEVED", "FAILED"), "RETRIEVED": ("STANDARDIZED", "FAILED"), "STANDARDIZED": ("VALIDATED", "QUARANTINED", "FAILED"), "VALIDATED": ("PROMOTED", "FAILED"), "PROMOTED": ("FINALIZED", "FAILED")}


def closure(edges: DataFrame, start: str, end: str) -> DataFrame:
    """All (start, end) pairs joined by a path, by doubling until a round adds none: depth d takes log2(d) joins."""
    reach = settled(edges.select(start, end).distinct(), "reach")
    known, found = -1, reach.count()
    while found != known:
        a, b = reach.select(start, F.col(end).alias("m_")), reach.select(F.col(start).alias("m_"), end)
        reach = settled(reach.unionByName(a.join(b, "m_").select(start, end)).distinct(), "reach")
        known, found = found, reach.count()
    return reach


def ancestors(edges: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """edges: child, parent. (artifact, ancestor) pairs, however deep; asked (a column artifact): of these artifacts only.

    Of the other nodes only the ancestors at distance 1, 2, 4, ... are kept, one distance at a time, so that a chain of
    d nodes takes log2(d) joins of d rows and no pairs but those asked for.
    """
    steps = settled(edges.select(F.col("child").alias("from_"), F.col("parent").alias("to_")).distinct(), "steps")
    if asked is None:
        return closure(steps, "from_", "to_").select(F.col("from_").alias("artifact"), F.col("to_").alias("ancestor"))
    reach = settled(asked.select("artifact").distinct().join(steps, F.col("artifact") == F.col("from_")).select("artifact", F.col("to_").alias("ancestor")), "reach")
    known, found = -1, reach.count()
    while found != known:
        further = reach.join(steps, F.col("ancestor") == F.col("from_")).select("artifact", F.col("to_").alias("ancestor"))
        reach = settled(reach.unionByName(further).distinct(), "reach")
        known, found = found, reach.count()
        twice = steps.select(F.col("from_").alias("to_"), F.col("to_").alias("then_"))
        steps = settled(steps.join(twice, "to_").select("from_", F.col("then_").alias("to_")).distinct(), "steps")
    return reach


def without_ends(edges: DataFrame) -> DataFrame:
    """Edges (s, e, edge) that begin where another ends and end where another begins."""
    return edges.join(edges.select(F.col("e").alias("s")).distinct(), "s", "left_semi").join(edges.select(F.col("s").alias("e")).distinct(), "e", "left_semi").select("s", "e", "edge")


def chain_heads(edges: DataFrame, inner: DataFrame) -> DataFrame:
    """edge, head: the first edge of the chain that an edge lies in, by pointer doubling; inner nodes have one edge in and one out.

    Edges of a ring of inner nodes have no head (NULL).
    """
    before = edges.join(inner, edges["s"] == inner["node"]).select("edge", F.col("node").alias("e")).join(edges.select("e", F.col("edge").alias("head")), "e").select("edge", "head")
    first = edges.join(inner, edges["s"] == inner["node"], "left_anti").select(F.col("edge").alias("head"), F.lit(True).alias("first"))
    now = settled(first.select(F.col("head").alias("edge"), "head").unionByName(before), "heads")
    for _ in range(now.count().bit_length()):
        if now.join(first, "head", "left_anti").isEmpty():
            break
        further = now.select(F.col("edge").alias("head"), F.col("head").alias("then"))
        now = settled(now.join(further, "head").select("edge", F.col("then").alias("head")), "heads")
    return now.join(first, "head", "left").select("edge", F.when(F.col("first"), F.col("head")).alias("head"))


def cyclic_nodes(edges: DataFrame, start: str, end: str) -> DataFrame:
    """node: the nodes that lie on a cycle, also of one edge.

    Ends are taken off and chains become one edge, in turn, until neither is left; a chain of d nodes takes log2(d)
    joins. Edges that close on themselves are cycles. Only what remains, where cycles meet, is asked for all its paths.
    """
    raw = settled(edges.select(F.col(start).alias("s"), F.col(end).alias("e")).distinct(), "edges")
    found = raw.filter("s = e").select(F.col("s").alias("node"))
    now = settled(raw.filter("s <> e").withColumn("edge", F.monotonically_increasing_id()), "edges")
    own = now.select(F.col("s").alias("node"), "edge")
    left, held = -1, now.count()
    while held and held != left:
        now = settled(without_ends(now), "edges")
        single = lambda c: now.groupBy(F.col(c).alias("node")).count().filter("count = 1").select("node")  # noqa: B023, E731
        inner = settled(single("s").join(single("e"), "node"), "inner")
        if not inner.isEmpty():
            heads = settled(chain_heads(now, inner), "heads")
            own = own.join(heads, "edge").select("node", F.col("head").alias("edge"))
            found, own = found.unionByName(own.filter("edge IS NULL").select("node")), settled(own.filter("edge IS NOT NULL"), "own")
            begins = now.select("s", F.col("edge").alias("head"))
            ends = now.join(inner, now["e"] == inner["node"], "left_anti").select("e", "edge").join(heads, "edge").select("head", "e")
            now = settled(begins.join(ends, "head").select("s", "e", F.col("head").alias("edge")), "edges")
            found = found.unionByName(own.join(now.filter("s = e"), "edge", "left_semi").select("node"))
            now = now.filter("s <> e")
        left, held = held, now.count()
    if held:
        back = closure(now, "s", "e").select(F.col("s").alias("e"), F.col("e").alias("s"))
        found = found.unionByName(own.join(now.join(back, ["s", "e"], "left_semi"), "edge", "left_semi").select("node"))
    return found.distinct()


def illegal_steps(journal: DataFrame, key: str, order: str, state: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Rows of a journal whose step from the state before isn't allowed."""
    pairs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, bs in allowed.items() for b in bs]
    out = journal.withColumn("was", F.lag(state).over(Window.partitionBy(key).orderBy(order)))
    return out.filter(F.col("was").isNotNull() & ~F.array_contains(F.array(*pairs), F.struct(F.col("was").alias("a"), F.col(state).alias("b"))))


def last_state(journal: DataFrame, key: str, order: str, state: str) -> DataFrame:
    return journal.groupBy(key).agg(F.max_by(state, order).alias("state"), F.count("*").alias("events"))


def membership_change(df: DataFrame, keys: list[str], date: str, member: str) -> DataFrame:
    """Per date: how many members came and went since the date before."""
    sets = df.groupBy(*keys, date).agg(F.collect_set(member).alias("now"))
    was = F.lag("now").over(Window.partitionBy(*keys).orderBy(date))
    pairs = sets.withColumn("was", was).filter("was IS NOT NULL")
    return pairs.select(*keys, date, F.size(F.array_except("now", "was")).cast("long").alias("came"), F.size(F.array_except("was", "now")).cast("long").alias("went"), F.size(F.array_union("now", "was")).cast("long").alias("either"))


def top_k(df: DataFrame, keys: list[str], by: str, k: int, ties: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc(), ties)
    return df.withColumn("k_", F.row_number().over(w)).filter(F.col("k_") <= k).drop("k_")
