"""Operator 13: packing documents into training sequences by swap-based local search.

Documents become token ids and an end id; only those longer than a sequence are
cut, the first piece being the shorter one. Pieces are dealt out at random into
groups of about GROUP pieces. A group is first packed best fit, longest first. Then
underfull bins trade pieces: a bin gives one piece or two and takes none, one or
two shorter ones (never two for two) from a fuller bin that has room for the
difference, so that the sum of squared fills grows with every step; bins that have
given everything away are gone. Bins are gone through from the emptiest on, each trading
until nothing is left to gain, again and again until a round empties none, or until
no further bin can go by the sum of the lengths.

What a trade needs is found without looking at pairs of bins: a table by length (of a
piece, or of two pieces of a bin) and room names the bins that could give it, and the
one that would be filled best is taken.

Every group hands its KEEP emptiest bins on; FAN groups meet and trade on as one,
until one group is left. So no task holds more than a group, and what is lost to
the dealing is won back in a few rounds over few rows.

Ids are those of the `tokenizers` file. They are computed by tiktoken from the same
vocabulary, which is some eight times faster; both agree on every code point, and
tests compare them.

Defined results: a null text is empty and becomes the end id alone; repeated rows
and null ids are pieces of their own; other columns are ignored by `pieces`, and
`packed` hands on all columns of its input.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitwell.llm.shared import documents, slices, stored

CAPACITY, END = 2048, 0
#: Pieces that are packed together, bins that a group hands on, and groups that meet.
GROUP, KEEP, FAN = 1 << 16, 16, 32
VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def token_ids(text: str, path: str) -> np.ndarray:
    """Ids of a text and the end id."""
    return np.append(encoding(path).encode_to_numpy(text, allowed_special="all"), np.uint32(END)).astype("<u4")


def cuts(n: int, capacity: int) -> list[int]:
    """Starts of the pieces of a document of n ids: all but the first are full."""
    return [0, *range(n % capacity or capacity, n, capacity)] if n > capacity else [0]


def pieces(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece; with_ids: and its ids."""
    path = path or vocabulary_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                owner, rows, held = [], [], []
                for i, text in enumerate(part.column("text")):
                    ids = token_ids(text.as_py() or "", path)
                    starts = cuts(len(ids), capacity)
                    for k, (a, z) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                        owner.append(i)
                        rows.append((k, a, z - a, crc32(ids[a:z].tobytes())))
                        if with_ids:
                            held.append(ids[a:z].astype(np.int32))
                k, start, length, crc = zip(*rows)
                columns = [part.column("doc_id").take(pa.array(owner)), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array(held, pa.list_(pa.int32()))] if with_ids else []), names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of lengths: longest first, each into the fullest bin that has room for it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms = 0  # bit r: some bin has room r
    for x in sorted(lengths, reverse=True):
        fitting = open_rooms >> x
        if fitting:
            room = x + (fitting & -fitting).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                open_rooms &= ~(1 << room)
            bins[k].append(x)
        else:
            room, k = capacity, len(bins)
            bins.append([x])
        if room > x:
            by_room[room - x].append(k)
            open_rooms |= 1 << room - x
    return bins


def pair_sums(bin_: list[int], capacity: int) -> dict[int, tuple[int, int]]:
    """Sums of two pieces of a bin, with the two lengths."""
    kinds = sorted(set(bin_))
    out = {a + b: (a, b) for i, a in enumerate(kinds) for b in kinds[i + 1 :] if a + b <= capacity}
    for a in kinds:
        if 2 * a not in out and bin_.count(a) > 1:
            out[2 * a] = (a, a)
    return out


class Trades:
    """Underfull bins, and for each length that a bin could give the bins that have it, by what they could take for it."""

    def __init__(self, bins: list[list[int]], capacity: int):
        self.bins, self.capacity = bins, capacity
        self.fill = [sum(b) for b in bins]
        #: Row 0: single pieces (length 0: nothing), row 1: pairs. There is a bin that takes up to `reach` and gives z at [row, reach, z].
        self.there = np.zeros((2, capacity + 1, capacity + 1), bool)
        self.givers: dict[tuple[int, int, int], set[int]] = {}
        for k in range(len(bins)):
            self.enter(k)

    def offers(self, k: int) -> Iterator[tuple[int, int, int]]:
        room = self.capacity - self.fill[k]
        if room and self.fill[k]:
            for row, lengths in enumerate(({0, *self.bins[k]}, pair_sums(self.bins[k], self.capacity))):
                for z in lengths:
                    yield row, room + z, z

    def enter(self, k: int) -> None:
        for offer in self.offers(k):
            self.givers.setdefault(offer, set()).add(k)
            self.there[offer] = True

    def leave(self, k: int) -> None:
        for offer in self.offers(k):
            self.givers[offer].discard(k)
            if not self.givers[offer]:
                self.there[offer] = False

    def trade(self, source: int, give: tuple[int, ...], rows: tuple[int, ...]) -> bool:
        """Moves the pieces `give` of the source, which has left, to a bin that it fills best, for shorter ones.

        A target keeps room reach - x; it must be less than the source has now, so that the fuller bin wins.
        """
        x, most = sum(give), self.capacity - self.fill[source]
        best = None
        for row in rows:
            offers = self.there[row, x : x + most, :x]
            at = int(offers.argmax()) if offers.size else 0
            if offers.size and offers.flat[at]:
                best = min(best or (self.capacity, 0, 0), (at // x, at % x, row))
        if best is None:
            return False
        spare, z, row = best
        target = next(iter(self.givers[row, x + spare, z]))
        back = () if not z else (z,) if not row else pair_sums(self.bins[target], self.capacity)[z]
        self.leave(target)
        for v in give:
            self.bins[source].remove(v)
            self.bins[target].append(v)
        for v in back:
            self.bins[target].remove(v)
            self.bins[source].append(v)
        self.fill[source] -= x - z
        self.fill[target] += x - z
        self.enter(target)
        return True

    def relieve(self, source: int) -> None:
        """Trades of one bin, its longest pieces first, until none is left or the bin is empty."""
        self.leave(source)
        done = True
        while done and self.fill[source]:
            singles = (((x,), (0, 1)) for x in sorted(set(self.bins[source]), reverse=True))
            pairs = ((p, (0,)) for p in pair_sums(self.bins[source], self.capacity).values())
            done = any(self.trade(source, give, rows) for give, rows in chain(singles, pairs))
        self.enter(source)


def traded(bins: list[list[int]], capacity: int) -> list[list[int]]:
    """The same pieces in the same bins or fewer; emptied bins stay in their places as empty lists."""
    least = -(-sum(map(sum, bins)) // capacity)
    used = sum(map(bool, bins))
    if used <= least:
        return bins
    state = Trades([b for b in bins if b and sum(b) < capacity], capacity)
    emptied = True
    while emptied and used > least:
        emptied = False
        for source in sorted(range(len(state.bins)), key=lambda k: state.fill[k]):
            if 0 < state.fill[source] < capacity:
                state.relieve(source)
                if not state.fill[source]:
                    emptied, used = True, used - 1
                    if used == least:
                        break
    return bins


def pack_group(lengths: np.ndarray, bin_of: np.ndarray | None, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset and the bin's fill of every piece; bin_of: bins to start from, else best fit."""
    order = np.argsort(lengths, kind="stable")
    if bin_of is None:
        bins = best_fit(lengths.tolist(), capacity)
    else:
        bins = [[] for _ in range(int(bin_of.max()) + 1)]
        for k, x in zip(bin_of.tolist(), lengths.tolist()):
            bins[k].append(x)
    bins = traded(bins, capacity)
    # Pieces of one length are alike: places of each length are handed to its rows in turn.
    flat = np.array([x for b in bins for x in b], np.int64)
    number = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
    fill = np.array([sum(b) for b in bins], np.int64)
    ends = np.cumsum(flat)
    offset = ends - flat - np.concatenate([[0], np.cumsum(fill)])[:-1][number]
    place = np.argsort(flat, kind="stable")
    out = np.empty((3, len(lengths)), np.int64)
    out[:, order] = number[place], offset[place], fill[number[place]]
    return out[0], out[1], out[2]


def packed_groups(rows: DataFrame, capacity: int, keep: int) -> DataFrame:
    """rows of group, sequence_id (null at first), length with sequence_id, offset and whether their bin is handed on."""

    def run(table: pa.Table) -> pa.Table:
        lengths, ids = table.column("length").to_numpy(), table.column("sequence_id")
        if ids.null_count:
            number, offset, fill = pack_group(lengths, None, capacity)
            sequence = number + (table.column("group")[0].as_py() << 32)
        else:
            known, at = np.unique(ids.to_numpy(), return_inverse=True)
            number, offset, fill = pack_group(lengths, at, capacity)
            sequence = known[number]
        bins, first = np.unique(number, return_index=True)
        under = bins[np.argsort(fill[first], kind="stable")][:keep]
        on = np.isin(number, under) & (fill < capacity)
        for name, x in (("sequence_id", pa.array(sequence)), ("offset", pa.array(offset)), ("on", pa.array(on))):
            table = table.set_column(table.schema.get_field_index(name), name, x)
        return table

    return rows.groupBy("group").applyInArrow(run, rows.schema)


def packed(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, keep: int = KEEP, fan: int = FAN) -> DataFrame:
    """The stored pieces (a column `length`, from 1 to capacity) with sequence_id and offset, which replace columns of these names."""
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    whole = F.struct(*(F.col(f"`{c}`") for c in names))
    # The numbers of rows of a stored table stay the same when a task runs again.
    numbered = pieces.select(whole.alias("row"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("nth"))
    full = numbered.filter(F.col("length") == capacity).select("row", (-1 - F.col("nth")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    short = numbered.filter(F.col("length") < capacity)
    groups = -(-short.count() // group)
    none = F.lit(None).cast("long")
    rows = short.select("row", "length", F.pmod(F.xxhash64("nth"), F.lit(max(1, groups))).alias("group"), none.alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(False).alias("on"))
    out = full
    while groups:
        rows = stored(packed_groups(rows, capacity, keep), "op13-packed")
        last = groups == 1
        out = out.unionByName((rows if last else rows.filter(~F.col("on"))).select("row", "sequence_id", "offset"))
        groups = 0 if last else -(-groups // fan)
        rows = rows.filter("on").withColumn("group", F.floor(F.col("group") / fan))
    return out.select("row.*", "sequence_id", "offset")


def sequences(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, ids: the packed training sequences themselves."""
    plan = packed(stored(pieces(docs, capacity, with_ids=True), "op13-ids"), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return plan.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(stored(pieces(documents(spark, sf_dir)), "op13-pieces"))
