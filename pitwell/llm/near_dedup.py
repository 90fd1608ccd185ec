"""Operator 2: n-gram Jaccard join with globally ordered sets in prefix trees.

A document's set holds the hashes of its distinct 5-word shingles. The join is
exact (up to collisions of 64-bit hashes within a pair, 2**-64 for each two
shingles) and runs over classes of documents with equal sets:

1. Screen. Under the order of the hashes, two linked sets share a known number
   of their first 40 %; sets that share fewer with any other set drop out.
   Each task first settles what its own sets share, so that one row of a shingle
   leaves it at most; this is the only shuffle that grows with all words.
2. Order. For the sets that are left, shingles are ordered from rare to frequent
   (counted over these sets), so that shared passages come last.
3. Prefix join. Two linked sets share a shingle among their first
   n - ceil(0.75 n) + 1; postings of those shingles give candidates, pruned by
   length and by what can remain behind the shared shingle. Members of a posting
   list are first joined to its first member and to their neighbour; members that
   then still lie in different components are compared further, block by block,
   so that no list is written out as pairs.
4. Tries. The sets of a block stand in a trie in the global order. All probes go
   down the tries of a task together, level by level: the overlap of a common
   beginning is counted once for all sets below it, a subtree is left as soon as
   the shingles remaining in it cannot reach the bound, and an edge with one set
   below it is walked at once. Lists of any length are joined this way.
5. Components of the links by alternating stars, as tables in the shared folder.

Defined results: no words, empty or null text: empty set, linked with nothing;
fewer than five words: one shingle of all words; a null doc_id takes part and is
never the component id unless all of its component are null; repeated rows are
linked with each other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitwell.llm.shared import Words, as_long, documents, in_batches, key_join, keyed, mix, one_of_equal, parts_of, slices, span_hash, spread_join, stored

SHINGLE = 5
#: Share of a set's hash order that the screen looks at, in tenths, and the least shared part of a set (0.15 x 0.75).
SCREEN_TENTHS, LEAST_SHARED = 4, 0.1125
#: Sets of a trie; postings of one shingle that a task orders; rows that a task settles by itself at once.
BLOCK, LIST_PART, LOCAL_ROWS = 256, 512, 1 << 20
#: Pairs of a probe and a set, and shingles, that are compared at once.
PAIRS_AT_ONCE, SHINGLES_AT_ONCE = 1 << 18, 1 << 20
BROADCAST_IDS = 500_000


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = Words(texts, lower=True)
    first, hashes = w.windows(size)
    cut = np.searchsorted(first, w.first)
    short = np.flatnonzero((w.count > 0) & (w.count < size))
    out = [np.unique(hashes[a:b]) for a, b in zip(cut.tolist(), cut[1:].tolist())]
    if len(short):
        whole = span_hash(w.hash, w.first[short], w.first[short + 1])
        for i, h in zip(short.tolist(), whole):
            out[i] = np.array([h], np.uint64)
    return out


def signature(shingles: np.ndarray) -> np.uint64:
    """One hash of a whole set."""
    return mix(mix(shingles + np.uint64(0x9E3779B97F4A7C15)).sum(dtype=np.uint64, keepdims=True) + np.uint64(len(shingles)))[0]


def set_table(docs: DataFrame) -> DataFrame:
    """doc_id, n, sig of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                sets = shingle_sets(part.column("text"))
                sig = np.array([signature(s) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int32()), as_long(sig)], names=["doc_id", "n", "sig"])

    return docs.select("doc_id", "text").transform(in_batches, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n int, sig long")


def screened(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """sig, doc_id of the classes (sig, n, doc_id) that share enough of their first shingles with other sets."""

    def settled(shingle: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Sets that share a shingle here get their hits now (a row dealt by the set, open = -hits); a shingle leaves with one set, open = 1 if that has no hit for it yet."""
        order = np.lexsort((sig, shingle))
        shingle, sig = shingle[order], sig[order]
        del order
        new = np.ones(len(shingle), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (sig[1:] != sig[:-1])
        shingle, sig = shingle[new], sig[new]
        first = np.ones(len(shingle), bool)
        first[1:] = shingle[1:] != shingle[:-1]
        size = np.diff(np.append(np.flatnonzero(first), len(shingle)))
        alone = size == 1
        yield from parts_of(pa.RecordBatch.from_arrays([as_long(shingle[first]), as_long(sig[first]), pa.array(alone.astype(np.int32))], names=["shingle", "sig", "open"]))
        hit, count = np.unique(sig[np.repeat(~alone, size)], return_counts=True)
        yield pa.RecordBatch.from_arrays([as_long(hit), as_long(hit), pa.array(-count.astype(np.int32))], names=["shingle", "sig", "open"])

    def first_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, sigs, sizes, held = [], [], [], 0

        def taken() -> tuple[np.ndarray, np.ndarray]:
            out = np.concatenate(shingles), np.repeat(np.array(sigs, np.uint64), sizes)
            for x in (shingles, sigs, sizes):
                x.clear()
            return out

        for b in batches:
            for part in slices(b):
                for s in shingle_sets(part.column(0)):
                    if len(s):
                        # A copy: a part of the array would hold all of it.
                        shingles.append(s[: max(-(-len(s) * SCREEN_TENTHS // 10), len(s) - (-(-3 * len(s) // 4)) + 1)].copy())
                        sigs.append(signature(s))
                        sizes.append(len(shingles[-1]))
                        held += sizes[-1]
                if held >= LOCAL_ROWS:
                    yield from settled(*taken())
                    held = 0
        if held:
            yield from settled(*taken())

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hits of the open rows whose shingle another set has too. Rows come sorted by shingle and set; the last shingle waits."""

        def counted(s: np.ndarray, g: np.ndarray, o: np.ndarray) -> pa.RecordBatch:
            own, own_hits = g[o < 0], -o[o < 0]
            s, g, o = s[o >= 0], g[o >= 0], o[o >= 0]
            first = np.ones(len(s), bool)
            first[1:] = s[1:] != s[:-1]
            at = np.flatnonzero(first)
            size = np.diff(np.append(at, len(s)))
            several = np.repeat(np.minimum.reduceat(g, at) != np.maximum.reduceat(g, at), size) if len(s) else first
            sig, count = np.unique(g[several & (o == 1)], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(np.append(sig, own)), pa.array(np.append(count, own_hits).astype(np.int64))], names=["sig", "hits"])

        held: list[tuple] = []
        for b in batches:
            if not b.num_rows:
                continue
            s, g, o = (c.to_numpy() for c in b.columns)
            cut = int(np.searchsorted(s, s[-1]))
            if cut:
                held.append((s[:cut], g[:cut], o[:cut]))
                yield counted(*map(np.concatenate, zip(*held)))
                held = []
            held.append((s[cut:], g[cut:], o[cut:]))
        if held:
            yield counted(*map(np.concatenate, zip(*held)))

    rows = docs.filter("text IS NOT NULL").select("text").transform(in_batches, first_part, "shingle long, sig long, open int")
    dealt = rows.repartition("shingle").sortWithinPartitions("shingle", "sig")
    counts = dealt.transform(in_batches, shared, "sig long, hits long").groupBy("sig").agg(F.sum("hits").alias("hits"))
    return counts.join(classes, "sig").filter(F.col("hits") >= F.greatest(F.lit(1), F.floor(F.col("n") * LEAST_SHARED))).select("sig", "doc_id")


def ordered_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """sig, n, lone, shingles: shared shingles from rare to frequent; lone: how many no other wanted set has. wanted: sig, doc_id."""
    ids, sigs = wanted.select(F.col("doc_id").alias("wanted_id")), wanted.select("sig")
    if wanted.count() <= BROADCAST_IDS:
        ids, sigs = F.broadcast(ids), F.broadcast(sigs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                sets = [s for s in shingle_sets(part.column(0)) if len(s)]
                size = [len(s) for s in sets]
                if sets:
                    sig = np.repeat(np.array([signature(s) for s in sets], np.uint64), size)
                    yield pa.RecordBatch.from_arrays([as_long(np.concatenate(sets)), as_long(sig), pa.array(np.repeat(size, size).astype(np.int32))], names=["shingle", "sig", "n"])

    texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["wanted_id"]), "left_semi").select("text")
    rows = texts.transform(in_batches, run, "shingle long, sig long, n int")
    rows = stored(rows.join(sigs, "sig", "left_semi"), "op2-shingles")
    # A null or repeated id may bring in copies of a set; counts only order the shingles, and lists are made distinct.
    counts = stored(rows.groupBy("shingle").agg(F.count("*").alias("n"), (F.min("sig") < F.max("sig")).alias("several")).filter("several").select("shingle", "n", F.col("n").alias("c")), "op2-counts")
    rows = spread_join(rows.withColumnRenamed("n", "size"), counts, "shingle")
    held = rows.groupBy("sig", F.col("size").alias("n")).agg(F.array_sort(F.collect_set(F.struct("c", "shingle"))).alias("s"))
    return held.select("sig", "n", (F.col("n") - F.size("s")).alias("lone"), F.col("s.shingle").alias("shingles"), F.col("s.c").alias("counts")).filter("4 * (n - lone) >= 3 * n")


def postings_of(sets: DataFrame) -> DataFrame:
    """shingle, sig, n, pos, part: the prefix of each ordered set; lone shingles come first and match nothing. Long lists fall into parts."""
    length = F.expr("n - cast(ceil(n * 3 / 4) as int) + 1 - lone")
    zipped = F.arrays_zip(F.slice("shingles", 1, length).alias("shingle"), F.slice("counts", 1, length).alias("c"))
    rows = sets.select("sig", "n", "lone", F.posexplode(zipped).alias("at", "x"))
    part = F.pmod(F.xxhash64("sig"), 1 + F.floor(F.col("x.c") / LIST_PART)).cast("int")
    return rows.select("x.shingle", "sig", "n", (F.col("at") + F.col("lone")).alias("pos"), part.alias("part"))


def can_link(n1: str, p1: str, n2: str, p2: str):
    reach = F.expr(f"1 + least({n1} - {p1}, {n2} - {p2}) - 1")
    return (F.expr(f"4 * least({n1}, {n2}) >= 3 * greatest({n1}, {n2})")) & (7 * reach >= F.expr(f"3 * ({n1} + {n2})"))


def neighbour_pairs(postings: DataFrame) -> DataFrame:
    """Candidates (a < b): each member of a part of a posting list with the part's first member and with the one before it; first members of parts likewise."""
    member = F.struct("sig", "n", "pos")

    def near(rows: DataFrame, *by: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy("n", "sig")
        return rows.select("shingle", "sig", "n", "pos", F.first(member).over(order).alias("first"), F.lag(member).over(order).alias("before"))

    rows = stored(near(postings, "shingle", "part"), "op2-near")
    firsts = near(rows.filter("before IS NULL"), "shingle")
    rows = rows.unionByName(firsts).select("sig", "n", "pos", F.explode(F.array("first", "before")).alias("o")).filter("o.sig IS NOT NULL AND o.sig <> sig")
    return paired(rows.filter(can_link("n", "pos", "o.n", "o.pos")).select("sig", F.col("o.sig").alias("other")))


def paired(rows: DataFrame) -> DataFrame:
    return rows.select(F.least("sig", "other").alias("a"), F.greatest("sig", "other").alias("b")).distinct()


def mixed_postings(postings: DataFrame, component: DataFrame) -> DataFrame:
    """Posting lists whose members lie in several components: shingle, sig, n, pos, c."""
    rows = stored(postings.join(component, "sig", "left").withColumn("c", F.coalesce("component", "sig")).select("shingle", "sig", F.col("n").alias("size"), "pos", "c"), "op2-named")
    mixed = rows.groupBy("shingle").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.count("*").alias("n")).filter("x <> y").select("shingle", "n")
    return stored(spread_join(rows, stored(mixed, "op2-lists"), "shingle").select("shingle", "sig", F.col("size").alias("n"), "pos", "c"), "op2-mixed")


class Sets:
    """Sets of a task: group, size n (with the shingles that no other set has), and the ordered shingles, all in a row."""

    def __init__(self, group: list[int], n: list[int], shingles: list[np.ndarray]):
        self.group, self.n = np.array(group, np.int64), np.array(n, np.int64)
        self.length = np.array([len(s) for s in shingles], np.int64)
        self.at = np.append(0, np.cumsum(self.length))
        self.tokens = np.concatenate([*shingles, np.zeros(0, np.int64)])


def repeated(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, ... count[i] places of each i, in a row."""
    total = int(count.sum())
    return np.repeat(start - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(total) if total else np.zeros(0, np.int64)


def trie_join(probes: Sets, members: Sets) -> tuple[np.ndarray, np.ndarray]:
    """Probes and members of one group (numbers from 0) with 100 * intersection >= 75 * union.

    The members of each group stand in a trie that is laid out level by level, as far as probes come.
    """
    names = np.unique(probes.tokens)
    held = np.sort(np.repeat(np.arange(len(probes.n)), probes.length) * np.int64(len(names) + 1) + np.searchsorted(names, probes.tokens))
    place = np.searchsorted(names, members.tokens)
    known = np.where((place < len(names)) & (names[np.minimum(place, len(names) - 1)] == members.tokens), place, len(names)) if len(names) else np.zeros(len(members.tokens), np.int64)

    def has(probe: np.ndarray, token: np.ndarray) -> np.ndarray:
        code = probe * np.int64(len(names) + 1) + token
        k = np.minimum(np.searchsorted(held, code), max(0, len(held) - 1))
        return held[k] == code if len(held) else np.zeros(len(code), bool)

    reach = lambda p, hits, remaining, n: 7 * (hits + remaining) >= 3 * (probes.n[p] + n)
    out: list[tuple[np.ndarray, np.ndarray]] = []
    groups = int(max(probes.group.max(initial=-1), members.group.max(initial=-1))) + 1
    node, alive = members.group.copy(), np.arange(len(members.n))  # node of each member still in a trie
    front_p, front_node, front_hits = np.arange(len(probes.n)), probes.group.copy(), np.zeros(len(probes.n), np.int64)
    depth, nodes = 0, groups
    while len(front_p) and len(alive):
        # Members that end at this node are met by all probes there; edges with one member below them are walked at once.
        below = np.bincount(node, minlength=nodes)
        ends = (members.length[alive] == depth) | (below[node] == 1)
        order = np.argsort(front_node, kind="stable")
        front_p, front_node, front_hits = front_p[order], front_node[order], front_hits[order]
        lo, hi = np.searchsorted(front_node, node[ends]), np.searchsorted(front_node, node[ends], "right")
        m, at = np.repeat(alive[ends], hi - lo), repeated(lo, hi - lo)
        p, hits = front_p[at], front_hits[at]
        left = members.length[m] - depth
        fits = reach(p, hits, left, members.n[m])
        m, p, hits, left = m[fits], p[fits], hits[fits], left[fits]
        cuts = np.append(0, np.cumsum(left)) // SHINGLES_AT_ONCE
        for part in np.split(np.arange(len(m)), np.flatnonzero(np.diff(cuts[:-1])) + 1) if len(m) else ():
            where = repeated(members.at[m[part]] + depth, left[part])
            hits[part] += np.bincount(np.repeat(np.arange(len(part)), left[part]), has(np.repeat(p[part], left[part]), known[where]), len(part)).astype(np.int64)
        linked = reach(p, hits, 0, members.n[m])
        out.append((p[linked], m[linked]))
        alive, node = alive[~ends], node[~ends]
        if not len(alive):
            break
        # Children: one for each shingle behind a node, with what can remain below it and the smallest set there.
        step = members.tokens[members.at[alive] + depth]
        order = np.lexsort((step, node))
        alive, node, step = alive[order], node[order], step[order]
        new = np.ones(len(alive), bool)
        new[1:] = (node[1:] != node[:-1]) | (step[1:] != step[:-1])
        at = np.flatnonzero(new)
        parent, child = node[at], np.cumsum(new) - 1
        remaining = np.maximum.reduceat(members.length[alive], at) - depth - 1
        least = np.minimum.reduceat(members.n[alive], at)
        lo, hi = np.searchsorted(parent, front_node), np.searchsorted(parent, front_node, "right")
        front_p, front_hits, to = np.repeat(front_p, hi - lo), np.repeat(front_hits, hi - lo), repeated(lo, hi - lo)
        front_hits = front_hits + has(front_p, known[members.at[alive[at]] + depth][to])
        fits = reach(front_p, front_hits, remaining[to], least[to])
        front_p, front_node, front_hits = front_p[fits], to[fits], front_hits[fits]
        depth, nodes = depth + 1, len(at)
        # Subtrees that no probe enters are left.
        wanted = np.zeros(nodes, bool)
        wanted[front_node] = True
        stay = wanted[child]
        alive, node = alive[stay], child[stay]
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (name, smallest name) that connect what the links a - b connect."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(names))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        label = label[label]
        if (label == before).all():
            break
    other = label != np.arange(len(names))
    return names[other], names[label[other]]


def joined_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of rows (x, y, side, sig, n, shingles) sorted by group (x, y) and side: members of side 0 probe the trie of side 1, or of side 0 where x = y."""
    sides: tuple[list, list] = ([], [])
    now, groups, pairs, tokens = None, 0, 0, 0
    count = [0, 0]

    def found() -> Iterator[pa.RecordBatch]:
        probes, members = (Sets([r[0] for r in s], [r[2] for r in s], [r[3] for r in s]) for s in sides)
        p, m = trie_join(probes, members)
        a, b = np.array([r[1] for r in sides[0]], np.int64)[p], np.array([r[1] for r in sides[1]], np.int64)[m]
        other = a != b
        if other.any():
            a, b = spanning(a[other], b[other])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        for s in sides:
            s.clear()

    for batch in batches:
        x, y, side, sig, n = (batch.column(k).to_pylist() for k in range(5))
        for i in range(batch.num_rows):
            if now != (x[i], y[i]):
                pairs, count = pairs + count[0] * count[1], [0, 0]
                if pairs > PAIRS_AT_ONCE or tokens > SHINGLES_AT_ONCE:
                    yield from found()
                    groups = pairs = tokens = 0
                now, groups = (x[i], y[i]), groups + 1
            shingles = batch.column(5)[i].values.to_numpy()
            for k in (0, 1) if x[i] == y[i] else (side[i],):
                sides[k].append((groups - 1, sig[i], n[i], shingles))
                count[k] += 1
                tokens += len(shingles)
    if sides[0]:
        yield from found()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links that connect what the pairs (a, b) with 100 * intersection >= 75 * union connect; the sets b of one a stand in tries of about BLOCK."""
    blocks = stored(pairs.groupBy("a").agg(F.count("*").alias("n"), F.expr(f"cast((count(*) + {BLOCK} - 1) div {BLOCK} as int)").alias("blocks")), "op2-blocks")
    s = sets.select(F.col("sig").alias("s"), F.col("n").alias("size"), "shingles")
    members = spread_join(pairs, blocks, "a").select("a", F.pmod(F.xxhash64("b"), "blocks").cast("long").alias("y"), "b")
    members = members.join(s, F.col("b") == F.col("s")).select(F.col("a").alias("x"), "y", F.lit(1).alias("side"), F.col("b").alias("sig"), F.col("size").alias("n"), "shingles")
    probes = blocks.withColumn("y", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1))).join(s, F.col("a") == F.col("s")).select(F.col("a").alias("x"), "y", F.lit(0).alias("side"), F.col("a").alias("sig"), F.col("size").alias("n"), "shingles")
    # Names of groups must not be equal by chance, which means something else in joined_groups.
    rows = probes.unionByName(members).withColumn("y", F.when(F.col("x") == F.col("y"), -1 - F.col("y")).otherwise(F.col("y")))
    return rows.repartition("x", "y").sortWithinPartitions("x", "y", "side").transform(in_batches, joined_groups, "a long, b long").distinct()


def list_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect what the sets of mixed posting lists connect.

    Sets that share their smallest such shingle, as near copies do, form blocks of about BLOCK; lists are compared block by block.
    """
    homes = stored(rows.groupBy("sig").agg(F.min("shingle").alias("home"), F.min("n").alias("size")), "op2-homes")
    sizes = stored(homes.groupBy("home").agg(F.count("*").alias("n"), F.greatest(F.lit(1), F.floor(F.count("*") / BLOCK)).alias("parts")), "op2-parts")
    blocks = stored(spread_join(homes, sizes, "home").select("sig", F.xxhash64("home", F.pmod(F.xxhash64("sig"), "parts")).alias("block")), "op2-blocks")
    left = F.col("n") - F.col("pos")
    lists = rows.join(blocks, "sig").groupBy("shingle", "block").agg(F.min("c").alias("c"), F.max("c").alias("d"), F.min("n").alias("low"), F.max("n").alias("high"), F.max(left).alias("left"))
    lists = stored(lists, "op2-lists")
    x = lists.select("shingle", *(F.col(k).alias(f"{k}1") for k in lists.columns[1:]))
    y = lists.select("shingle", *(F.col(k).alias(f"{k}2") for k in lists.columns[1:]))
    both = x.join(y, "shingle").filter("block1 <= block2 AND NOT (c1 = d1 AND c2 = d2 AND c1 = c2)")
    both = both.filter("4 * high1 >= 3 * low2 AND 4 * high2 >= 3 * low1 AND 7 * least(left1, left2) >= 3 * (low1 + low2)")
    pairs = both.select(F.col("block1").alias("x"), F.col("block2").alias("y")).distinct()
    members = blocks.join(sets.select("sig", "n", "shingles"), "sig")
    sides = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("block")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("x").alias("block")), F.struct(F.lit(1).alias("side"), F.col("y").alias("block"))))
    rows = pairs.select("x", "y", F.explode(sides).alias("s")).select("x", "y", "s.*").join(members, "block").select("x", "y", "side", "sig", "n", "shingles")
    return rows.repartition("x", "y").sortWithinPartitions("x", "y", "side").transform(in_batches, joined_groups, "a long, b long").distinct()


def components(links: DataFrame, label: str = "op2-stars") -> DataFrame:
    """sig, component (the smallest sig of it) of all linked nodes, by alternating large and small stars."""
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), label)
    known = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select("u", "v", "m")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(small, label)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 30))).first()
        if state == known:
            break
        known = state
    return edges.select(F.col("u").alias("sig"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("sig"), F.col("v").alias("component"))).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    table = stored(set_table(docs), "op2-sets")
    classes = table.filter("n > 0").groupBy("sig", "n").agg(F.min("doc_id").alias("doc_id"))
    wanted = stored(screened(docs, classes), "op2-wanted")
    sets = stored(ordered_sets(docs, wanted), "op2-ordered")
    postings = stored(postings_of(sets), "op2-postings")
    tried = stored(neighbour_pairs(postings), "op2-tried")
    links = stored(verified(tried, sets), "op2-links")
    component = stored(components(links), "op2-component")
    more = stored(list_links(mixed_postings(postings, component), sets), "op2-links")
    if not more.isEmpty():
        bridges = component.select(F.col("sig").alias("a"), F.col("component").alias("b"))
        component = stored(components(more.unionByName(bridges)), "op2-component")
    named = table.join(component, "sig", "left").withColumn("c", F.coalesce("component", "sig"))
    least = stored(named.filter("n > 0").groupBy("c").agg(F.min("doc_id").alias("least"), F.count("*").alias("held")), "op2-least")
    joined = spread_join(named, least, "c", "left", count="held")
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns: the one with the smallest id, or without ids the smallest row_key.

    Rows without words are linked with nothing and stay, each of them.
    """
    found = stored(near_duplicates(keyed(docs)), "op2-found")
    gone = stored(found.filter("doc_id <> component_id").select("doc_id").distinct(), "op2-gone")
    left = key_join(docs, gone, "left_anti", BROADCAST_IDS)
    again = stored(found.filter("n_shingles > 0 AND doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "op2-again")
    if again.isEmpty():
        return left
    repeated = one_of_equal(key_join(left, again, "left_semi", BROADCAST_IDS), BROADCAST_IDS)
    return key_join(left, again, "left_anti", BROADCAST_IDS).unionByName(repeated)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
