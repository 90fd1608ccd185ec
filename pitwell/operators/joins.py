"""Point-in-time, effective-dated and holding-interval joins (C). None looks forward.

As-of joins are one union and one running window by key: no range join and no
blow-up. Interval joins give every interval the coarse time buckets it touches,
join on key and bucket, and filter; large histories stay distributed and small
ones are broadcast by the optimizer on their measured size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class JoinError(ValueError):
    """Raised in strict mode for ambiguous, missing or forward-looking evidence."""


def require_none(bad: DataFrame, message: str) -> None:
    if not bad.isEmpty():
        raise JoinError(message)


def pit_asof_panel(market: DataFrame, facts: DataFrame, fields: list[str], keys: list[str] = ["security_id"], date: str = "date") -> DataFrame:
    """Each market row with, per field, the value of the greatest available_at up to the end of its day; evidence_at is the latest used."""
    value = F.max_by("value", "available_at")
    pivoted = facts.groupBy(*keys, F.to_date("available_at").alias("at_")).pivot("field", fields).agg(value)
    rows = market.withColumn("at_", F.col(date)).withColumn("kind_", F.lit(1))
    facts_ = pivoted.withColumn("kind_", F.lit(0))
    w = Window.partitionBy(*keys).orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(facts_, allowMissingColumns=True)
    filled = {f: F.last(f, ignorenulls=True).over(w) for f in fields}
    seen = {f"at_{f}": F.last(F.when(F.col(f).isNotNull(), F.col("at_")), ignorenulls=True).over(w) for f in fields}
    out = both.withColumns({f"v_{f}": c for f, c in filled.items()} | seen).filter("kind_ = 1")
    latest = F.greatest(*(F.col(f"at_{f}") for f in fields)) if len(fields) > 1 else F.col(f"at_{fields[0]}")
    kept = [c for c in market.columns if c not in fields]
    return out.select(*kept, *(F.col(f"v_{f}").alias(f) for f in fields), latest.alias("evidence_at"))


def asof_single(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, strict: bool = False) -> DataFrame:
    """The latest `value` with right_time <= left_time. Strict: two values at one time are an error."""
    if strict:
        clash = right.groupBy(*keys, right_time).agg(F.count_distinct(value).alias("n")).filter("n > 1")
        require_none(clash, f"{value} has two values at one time")
    r = right.groupBy(*keys, F.col(right_time).alias("at_")).agg(F.max(value).alias("v_")).withColumn("kind_", F.lit(0))
    both = left.withColumn("at_", F.col(left_time)).withColumn("kind_", F.lit(1)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("at_", "kind_").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("v_", ignorenulls=True).over(w)).filter("kind_ = 1").drop("at_", "kind_", "v_")


#: Days of a bucket of a join by time alone.
DAY_BUCKETS = 7


def interval_join(rows: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, open_start: bool = False, bucket_days: int = 366, how: str = "inner", horizon: str = "2100-01-01") -> DataFrame:
    """Rows with the intervals [start, end] (or (start, end]) that hold `at`; a NULL end is open.

    Open ends reach to the rows' own last day, so that an interval spans few buckets. Without keys, rows meet by
    buckets of DAY_BUCKETS days, so that no long stretch of rows is one join key.
    """
    bucket_days = bucket_days if keys else DAY_BUCKETS
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / bucket_days).cast("long")
    last = rows.agg(F.max(at).alias("last_"))
    iv = intervals.crossJoin(F.broadcast(last)).withColumn("to_", F.coalesce(F.least(F.col(end), F.col("last_")), F.col("last_")))
    iv = iv.filter(F.col(start) <= F.col("to_")).withColumn("b_", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col("to_"))))).drop("last_", "to_")
    left = rows.withColumn("b_", bucket(F.col(at)))
    after = F.col(at) > F.col(start) if open_start else F.col(at) >= F.col(start)
    within = after & (F.col(end).isNull() | (F.col(at) <= F.col(end)))
    keyed = [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys] + [F.col("l.b_") == F.col("r.b_")]
    condition = keyed[-1]
    for c in keyed[:-1]:
        condition = condition & c
    joined = left.alias("l").join(iv.alias("r"), condition & within, how)
    extra = [c for c in intervals.columns if c not in keys]
    return joined.select(*(F.col(f"l.{c}") for c in rows.columns), *(F.col(f"r.{c}").alias(c) for c in extra if c not in rows.columns))


def effective_id(rows: DataFrame, mapping: DataFrame, key: str, at: str, value: str = "security_id", start: str = "valid_from", end: str = "valid_to") -> DataFrame:
    """Every row with the one distinct id valid at its date; none or several leave it unresolved (NULL), with the number found."""
    tagged = rows.withColumn("row_", F.monotonically_increasing_id()) if "row_" not in rows.columns else rows
    m = mapping.select(key, F.col(value).alias("id_"), start, end)
    found = interval_join(tagged, m, [key], at, start, end)
    ids = found.groupBy(key, at).agg(F.count_distinct("id_").alias("n_ids"), F.min("id_").alias("id_"))
    out = rows.join(ids, [key, at], "left")
    return out.withColumn("n_ids", F.coalesce("n_ids", F.lit(0))).withColumn(value, F.when(F.col("n_ids") == 1, F.col("id_"))).drop("id_")


def issuer_listings(rows: DataFrame, mapping: DataFrame, key: str, at: str, resolved: str = "RESOLVED", strict: bool = False) -> DataFrame:
    """All listings of an issuer at a date; has_unresolved tells if any active row isn't resolved."""
    found = interval_join(rows, mapping, [key], at, "valid_from", "valid_to")
    bad = found.groupBy(key, at).agg(F.bool_or(F.col("status") != resolved).alias("has_unresolved"))
    if strict:
        require_none(bad.filter("has_unresolved"), "an active listing is not resolved")
    return found.join(bad, [key, at])


def successor_at(rows: DataFrame, successions: DataFrame, key: str, at: str, strict: bool = False) -> DataFrame:
    """successions: key, successor, effective. The unique successor effective by the date; NULL if none or several distinct ones."""
    first = successions.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("effective", "successor"))).alias("s_"))
    out = rows.join(first, key, "left")
    valid = F.filter("s_", lambda x: x["effective"] <= F.col(at))
    ids = F.array_distinct(F.transform(valid, lambda x: x["successor"]))
    out = out.withColumn("ids_", ids)
    if strict:
        require_none(out.filter("size(ids_) > 1"), "two successors")
    return out.withColumn("successor", F.when(F.size("ids_") == 1, F.get("ids_", F.lit(0)))).drop("s_", "ids_")


def holding_rows(daily: DataFrame, intervals: DataFrame, at: str = "date", start: str = "start", end: str = "end", strict: bool = False) -> DataFrame:
    """Daily rows with each interval (start, end] that holds them. Strict: an interval without rows is an error."""
    out = interval_join(daily, intervals, [], at, start, end, open_start=True)
    if strict:
        require_none(intervals.join(out.select(start, end).distinct(), [start, end], "left_anti"), "an interval has no rows")
    return out


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], relation: str = "many_to_one", how: str = "inner") -> DataFrame:
    """An equi-join that raises on duplicate keys of the one side(s)."""
    require_none(right.groupBy(*keys).count().filter("count > 1"), "right keys repeat")
    if relation == "one_to_one":
        require_none(left.groupBy(*keys).count().filter("count > 1"), "left keys repeat")
    return left.join(right, keys, how)


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Key by key: side ('both', 'left_only', 'right_only') and the absolute difference of each value."""
    l = left.select(*keys, *(F.col(v).alias(f"l_{v}") for v in values), F.lit(True).alias("in_l"))
    r = right.select(*keys, *(F.col(v).alias(f"r_{v}") for v in values), F.lit(True).alias("in_r"))
    both = l.join(r, keys, "full_outer")
    side = F.when(F.col("in_l") & F.col("in_r"), "both").when(F.col("in_l"), "left_only").otherwise("right_only")
    return both.select(*keys, side.alias("side"), *(F.abs(F.col(f"l_{v}") - F.col(f"r_{v}")).alias(f"diff_{v}") for v in values))


def endpoint_return(intervals: DataFrame, prices: DataFrame, key: str, date: str = "date", price: str = "price", start: str = "entry", end: str = "exit") -> DataFrame:
    """Price at entry and at exit of each interval, and their ratio less 1."""
    a = prices.select(key, F.col(date).alias(start), F.col(price).alias("entry_price"))
    b = prices.select(key, F.col(date).alias(end), F.col(price).alias("exit_price"))
    out = intervals.join(a, [key, start], "left").join(b, [key, end], "left")
    return out.withColumn("path_return", F.try_divide("exit_price", "entry_price") - 1)


def pairwise(df: DataFrame, key: str, time: str, value: str, least: int = 2) -> DataFrame:
    """All pairs of a few series a < b of any length: common observations, largest difference and correlation. A row a pair and time; for many series see `block_pairs`."""
    a = df.select(F.col(key).alias("a"), F.col(time).alias("t"), F.col(value).alias("x"))
    b = df.select(F.col(key).alias("b"), F.col(time).alias("t"), F.col(value).alias("y"))
    both = a.join(b, "t").filter("a < b AND x IS NOT NULL AND y IS NOT NULL")
    return both.groupBy("a", "b").agg(F.count("*").alias("n"), F.max(F.abs(F.col("x") - F.col("y"))).alias("max_diff"), F.corr("x", "y").alias("corr")).filter(F.col("n") >= least)


#: Series of one block of `block_pairs`, at least, up to BLOCKS blocks; beyond, blocks grow up to so many observations. Two blocks meet in a group.
BLOCK_SERIES, BLOCKS, BLOCK_VALUES = 500, 16, 2_000_000
#: Equal series that are one row; side of a matrix; rows of a batch that leaves a task. Tasks that meet the blocks: their input is small, their output isn't.
EQUAL_SERIES, TILE, BATCH_ROWS, PAIR_TASKS = 256, 256, 200_000, 128


def block_pairs(df: DataFrame, key: str, time: str, value: str, least: int = 2, gap: bool = True, block_series: int = BLOCK_SERIES) -> DataFrame:
    """The rows of `pairwise` for many series, each short enough to be one row; without max_diff unless `gap`.

    Series that are equal in all times and values are one row with a list of keys. Rows are dealt into blocks by hash, and every
    two blocks meet as matrices (series by times), some hundred series at a time. No row is made for a pair at a time, the shuffle
    holds each series once a block (BLOCKS times, until blocks are full), and a task holds two blocks and a batch of its result.
    Keys of equal series leave side by side, so that their values repeat. Quadratic in series by nature, as is the result.
    """
    known = df.select(F.col(key).alias("k"), F.col(time).alias("t"), F.col(value).cast("double").alias("x")).filter("k IS NOT NULL AND t IS NOT NULL AND x IS NOT NULL")
    series = known.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("t", "x"))).alias("s")).select("k", F.col("s.t").alias("t"), F.col("s.x").alias("x")).withColumn("h", F.xxhash64("t", "x"))
    part = F.floor((F.row_number().over(Window.partitionBy("h").orderBy("k")) - 1) / EQUAL_SERIES)
    equal = series.withColumn("part", part).groupBy("h", "part", "t", "x").agg(F.collect_list("k").alias("ks"))
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCKS), F.ceil(F.approx_count_distinct("k") / block_series)), F.ceil(F.count("*") / BLOCK_VALUES))
    size = known.agg(most.cast("int").alias("blocks"))
    placed = equal.crossJoin(F.broadcast(size)).withColumn("mine", F.pmod(F.xxhash64("h", "part"), "blocks").cast("int"))
    met = placed.select("ks", "t", "x", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    met = met.select(F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"), (F.col("mine") > F.col("other")).alias("second"), "ks", "t", "x")
    kind = df.schema[key].dataType.simpleString()

    def two_blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _two_blocks(pa.Table.from_batches(list(rows)), least, gap)

    return met.repartition(PAIR_TASKS, "p", "q").groupBy("p", "q").applyInArrow(two_blocks, f"a {kind}, b {kind}, n long, {'max_diff double, ' if gap else ''}corr double")


def _two_blocks(rows: pa.Table, least: int, gap: bool) -> Iterator[pa.RecordBatch]:
    """Pairs between the series of two blocks, or among those of one, in batches."""
    same, second = rows["p"][0].as_py() == rows["q"][0].as_py(), rows["second"].to_numpy()
    ks, t, x = (rows[c].combine_chunks() for c in ("ks", "t", "x"))
    lengths, times, x = pc.list_value_length(t).to_numpy(), t.flatten().to_numpy(zero_copy_only=False), x.flatten().to_numpy()
    at, ends = np.unique(times, return_inverse=True)[1], np.cumsum(lengths)
    # Keys by their order, and each row's places among them: a pair's lesser place is its lesser key.
    sizes, keys = pc.list_value_length(ks).to_numpy().astype("int64"), ks.flatten()
    order = pc.sort_indices(keys)
    keys, place = keys.take(order), np.empty(len(keys), "int64")
    place[order.to_numpy()] = np.arange(len(keys))
    first = np.cumsum(sizes) - sizes
    cut = lambda k: (at[ends[k] - lengths[k] : ends[k]], x[ends[k] - lengths[k] : ends[k]])
    by_key = np.argsort(np.minimum.reduceat(place, first))
    left, right = (by_key,) * 2 if same else (by_key[~second[by_key]], by_key[second[by_key]])
    for f in range(0, len(left), TILE):
        for s in range(f if same else 0, len(right), TILE):
            found = _tile(left[f : f + TILE], right[s : s + TILE], sizes, cut, least, gap, same)
            yield from _members(*found, sizes, first, place, keys, gap)


def _tile(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, cut: Callable[[int], tuple[np.ndarray, np.ndarray]], least: int, gap: bool, same: bool) -> tuple[np.ndarray, ...]:
    """left, right, n, max_diff, corr and whether it is none, for rows that have a pair. Pairs that sums can't tell well are taken one by one."""
    both = np.concatenate([left, right])
    parts = [cut(k) for k in both]
    row, at = np.repeat(np.arange(len(both)), [len(p[0]) for p in parts]), np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)[1]
    shape = (len(both), int(at.max()) + 1)
    held, value = np.zeros(shape), np.full(shape, np.nan)
    np.add.at(held, (row, at), 1.0)
    value[row, at] = np.concatenate([p[1] for p in parts])
    here = np.isfinite(value)
    odd = ((held > 1) | (~here & (held > 0))).any(axis=1)
    value[~here] = np.nan
    m = here.astype(float)
    full = np.where(here, value, 0.0)
    c = np.where(here, full - full.sum(axis=1, keepdims=True) / np.maximum(m.sum(axis=1, keepdims=True), 1), 0.0)
    l, r = slice(0, len(left)), slice(len(left), None)
    a, b, ma, mb = c[l], c[r], m[l], m[r]
    n = ma @ mb.T
    some, sa, sb, qa, qb = np.maximum(n, 1), a @ mb.T, ma @ b.T, (a * a) @ mb.T, ma @ (b * b).T
    va, vb, ab = qa - sa * sa / some, qb - sb * sb / some, a @ b.T - sa * sb / some
    with np.errstate(divide="ignore", invalid="ignore"):
        corr = ab / np.sqrt(va * vb)
    wanted = np.ones(n.shape, bool)
    if same and left[0] == right[0]:
        # Among the same rows each pair comes once, and a row meets itself if it has several keys.
        wanted = np.triu(wanted, 1) | np.diag(sizes[left] > 1)
    single = wanted & (odd[l][:, None] | odd[r] | (n >= least) & ((va <= 1e-6 * qa) | (vb <= 1e-6 * qb)))
    g = np.full(n.shape, -np.inf)
    if gap:
        # Where one side lacks a time the difference is not a number, which fmax passes over.
        d = np.empty(n.shape)
        for u, v in zip(np.ascontiguousarray(value[l].T), np.ascontiguousarray(value[r].T)):
            np.fmax(g, np.abs(np.subtract(u[:, None], v, out=d), out=d), out=g)
    none = np.zeros(n.shape, bool)
    for i, j in zip(*np.nonzero(single)):
        n[i, j], g[i, j], one = _one_pair(*cut(left[i]), *cut(right[j]))
        none[i, j], corr[i, j] = one is None, one or 0.0
    i, j = np.nonzero(wanted & (n >= np.where(single, max(least, 1), least)))
    return left[i], right[j], n[i, j].astype("int64"), g[i, j], corr[i, j], none[i, j]


def _members(left: np.ndarray, right: np.ndarray, n: np.ndarray, far: np.ndarray, corr: np.ndarray, none: np.ndarray, sizes: np.ndarray, first: np.ndarray, place: np.ndarray, keys: pa.Array, gap: bool) -> Iterator[pa.RecordBatch]:
    """Every key of a row with every key of the other, each pair of keys once."""
    width = sizes[right]
    count = sizes[left] * width
    ends, one_each = np.cumsum(count), bool((count == 1).all())
    for start in range(0, int(count.sum()), BATCH_ROWS):
        at = np.arange(start, min(start + BATCH_ROWS, ends[-1]))
        if one_each:
            p, i, j = at, 0, 0
        else:
            p = np.searchsorted(ends, at, side="right")
            i, j = np.divmod(at - (ends - count)[p], width[p])
        u, v = place[first[left[p]] + i], place[first[right[p]] + j]
        if (itself := left[p] == right[p]).any():
            kept = ~itself | (u < v)
            p, u, v = p[kept], u[kept], v[kept]
        out = {"a": keys.take(pa.array(np.minimum(u, v))), "b": keys.take(pa.array(np.maximum(u, v))), "n": pa.array(n[p]), **({"max_diff": pa.array(far[p])} if gap else {}), "corr": pa.array(corr[p], mask=none[p], from_pandas=False)}
        yield pa.RecordBatch.from_pydict(out)


def _one_pair(s: np.ndarray, x: np.ndarray, t: np.ndarray, y: np.ndarray) -> tuple[int, float, float | None]:
    """Count, largest difference and correlation of two series by their joined rows: repeated times, values that aren't finite, hardly any variance. None where a side doesn't vary."""
    i, j = np.nonzero(s[:, None] == t[None, :])
    if not len(i):
        return 0, 0.0, None
    u, v = x[i], y[j]
    with np.errstate(invalid="ignore"):
        far = np.abs(u - v).max()
        if np.isfinite(u).all() and np.isfinite(v).all() and (np.ptp(u) == 0 or np.ptp(v) == 0):
            return len(i), float(far), None
        du, dv = u - u.mean(), v - v.mean()
        return len(i), float(far), float((du * dv).sum() / np.sqrt((du * du).sum() * (dv * dv).sum()))


def constituent_overlap(members: DataFrame, legs: DataFrame, portfolio: list[str], signal: str = "factor_id", member: str = "security_id", weight: str = "weight") -> DataFrame:
    """For each portfolio and signal: share of members, by count and weight, that are also in the signal's legs.

    Members meet only the signals whose legs hold them; the shares of all others are 0. The list of signals is one row.
    """
    distinct = legs.select(F.col(signal).alias("signal"), member).distinct()
    hits = members.join(distinct, member).groupBy(*portfolio, "signal").agg(F.count("*").alias("hits_"), F.sum(weight).alias("hit_weight_"))
    totals = members.groupBy(*portfolio).agg(F.count("*").alias("n_"), F.sum(weight).alias("weight_"))
    signals = distinct.agg(F.collect_set("signal").alias("signals_"))
    every = totals.crossJoin(F.broadcast(signals)).withColumn("signal", F.explode("signals_"))
    share = lambda a, b: F.coalesce(F.col(a), F.lit(0.0)) / F.col(b)
    return every.join(hits, [*portfolio, "signal"], "left").select(*portfolio, "signal", share("hits_", "n_").alias("count_share"), share("hit_weight_", "weight_").alias("weight_share"))


def spread_without(legs: DataFrame, excluded: DataFrame, keys: list[str], member: str = "security_id", quantile: str = "quantile", weight: str = "weight", ret: str = "ret", top: int = 3) -> DataFrame:
    """Top minus bottom leg with excluded members removed and weights renormalised; NULL if a leg is empty."""
    left = legs.join(excluded, [*(k for k in keys if k in excluded.columns), member], "left_anti")
    leg = left.groupBy(*keys, quantile).agg((F.sum(F.col(weight) * F.col(ret)) / F.sum(weight)).alias("r_"))
    return leg.groupBy(*keys).agg((F.max(F.when(F.col(quantile) == top, F.col("r_"))) - F.max(F.when(F.col(quantile) == 1, F.col("r_")))).alias("spread"))


def prediction_equivalence(a: DataFrame, b: DataFrame, keys: list[str], fold: str, prediction: str = "prediction") -> DataFrame:
    """Two models' predictions by fold: largest difference, equal ranks, correlation."""
    both = a.select(fold, *keys, F.col(prediction).alias("x")).join(b.select(fold, *keys, F.col(prediction).alias("y")), [fold, *keys])
    rank = lambda c: F.rank().over(Window.partitionBy(fold).orderBy(c))
    both = both.withColumns({"rx": rank("x"), "ry": rank("y")})
    return both.groupBy(fold).agg(F.max(F.abs(F.col("x") - F.col("y"))).alias("max_diff"), F.bool_and(F.col("rx") == F.col("ry")).alias("same_ranks"), F.corr("x", "y").alias("corr"))


def semi(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    return df.join(ids, on, "left_semi")


def anti(df: DataFrame, ids: DataFrame, on: list[str]) -> DataFrame:
    return df.join(ids, on, "left_anti")


