"""The corpus operators against brute force, on texts with nulls, ties, copies and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pitwell.llm import exact_dedup, language_id, line_dedup, mixing, near_dedup, piece_codec, pii, quality, shared, substring_dedup, suffix_dedup

WORD = r"[^\x20\x09-\x0D]+"
r = random.Random(11)
BASE = [str(r.randint(0, 9999)) for _ in range(400)]


def changed(words, k):
    words = list(words)
    for _ in range(k):
        words[r.randrange(len(words))] = str(r.randint(0, 9999))
    return words


TEXTS = [" ".join(changed(BASE[:n], r.randint(0, 6))) for n in (3, 5, 30, 120, 300) for _ in range(8)]
TEXTS += [None, "", " ", "\n\n", "A b", "a B", "x " * 70, "y x " * 60, "x " * 70, "a\nb\nc\na\nb\n", "q\na\nb\nz", "é " * 50 + "ß", "mail me at joe.doe@example.com or +1 (826) 555-4081 190.137.223.204", "card 4111 1111 1111 1111 ip 10.0.0.256", TEXTS[30], TEXTS[30]]
TEXTS += ["".join(r.choice("abc é") for _ in range(700))] * 2
NEEDED = "doc_id long, text string, lang string, source string"


def table(spark, texts=TEXTS):
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", None, "s2", "s1")[i % 4], 1, "k", 2) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, NEEDED + ", n int, key string, start int")


def by_id(df):
    return {x.doc_id: x for x in df.collect()}


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def test_exact(spark):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for t in TEXTS]
    got = by_id(exact_dedup.exact_duplicates(table(spark)))
    for i, t in enumerate(norm):
        same = [j for j, u in enumerate(norm) if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (same[0], len(same), i == same[0], sha(t))
    assert exact_dedup.deduplicated(table(spark).union(table(spark))).count() == len(set(norm))


def test_directory_splits(spark):
    keys = spark.range(5000).select(F.xxhash64("id").alias("key"))
    d = exact_dedup.directory(keys, capacity=100, bits=8)
    held = keys.withColumn("slot", F.shiftrightunsigned("key", 56)).join(d, "slot").groupBy("bucket", "depth").count()
    assert held.agg(F.max("count")).first()[0] <= 100 and held.agg(F.sum("count")).first()[0] == 5000


def test_mix(spark):
    got = by_id(mixing.mix_plan(table(spark)))
    size = {i: len(re.findall(WORD, t or "")) for i, t in enumerate(TEXTS)}
    total = sum(size.values())
    targets, caps = {}, {}
    for x in got.values():
        targets[x.source], caps[x.source] = x.target, 2 * x.source_size
        assert x.size == size[x.doc_id] and x.taken <= 2 * x.size
    assert abs(sum(targets.values()) - 1.5 * total) < 1e-6 and all(targets[s] <= caps[s] + 1e-9 for s in targets)
    assert {i: x.taken for i, x in by_id(mixing.mix_plan(table(spark))).items()} == {i: x.taken for i, x in got.items()}


def test_near(spark):
    sets = []
    for t in TEXTS:
        w = re.findall(WORD, re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    got = by_id(near_dedup.near_duplicates(table(spark)))
    assert {i: (x.n_shingles, x.component_id) for i, x in got.items()} == {i: (len(s), find(i)) for i, s in enumerate(sets)}


def test_near_small_parts(spark, monkeypatch):
    """Lists of many parts, tries of few sets, keys of many rows met by broadcast, and tasks that settle little at once."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "LIST_PART", 3)
    monkeypatch.setattr(near_dedup, "LOCAL_ROWS", 50)
    monkeypatch.setattr(near_dedup, "PAIRS_AT_ONCE", 10)
    monkeypatch.setattr(shared, "HOT_KEYS", 5)
    test_near(spark)


def test_trie_join():
    for _ in range(60):
        make = lambda: [np.array(sorted(r.sample(range(30), r.randint(1, 20))), np.int64) for _ in range(r.randint(0, 12))]
        a, b = make(), make()
        groups = [[r.randint(0, 2) for _ in x] for x in (a, b)]
        lone = [[r.randint(0, 2) for _ in x] for x in (a, b)]
        sizes = [[len(s) + k for s, k in zip(x, e)] for x, e in zip((a, b), lone)]
        want = {(i, j) for i in range(len(a)) for j in range(len(b)) if groups[0][i] == groups[1][j] and 7 * len(set(a[i]) & set(b[j])) >= 3 * (sizes[0][i] + sizes[1][j])}
        p, m = near_dedup.trie_join(near_dedup.Sets(groups[0], sizes[0], a), near_dedup.Sets(groups[1], sizes[1], b))
        assert len(p) == len(want) and set(zip(p.tolist(), m.tolist())) == want


THUE = "".join("ab"[bin(i).count("1") % 2] for i in range(2048))
OTHER = THUE.translate(str.maketrans("ab", "ba"))


def test_hashes_tell_structured_texts_apart(spark):
    """A Thue-Morse string and its complement collide under polynomial hashes modulo 2**64."""
    assert quality.counts_of(pa.array([THUE + "\n" + OTHER, THUE + "\n" + THUE]))["n_dup_lines"].tolist() == [0, 1]
    a, b = (near_dedup.shingle_sets(pa.array([t + " b c d e f"]))[0].tolist() for t in (THUE, OTHER))
    assert set(a) != set(b) and len(set(a) & set(b)) == 1
    words = " ".join(map(str, range(19)))
    got = by_id(substring_dedup.without_repeats(table(spark, [THUE + " " + words, OTHER + " " + words])))
    assert got[0].n_removed == got[1].n_removed == 0
    data = np.frombuffer((THUE + OTHER).encode(), np.uint8)
    for n in (1, 7, 8, 9, 1024, 2048):
        x, y = shared.bytes_hash(data, np.array([0, 2048]), np.array([n, 2048 + n]))
        assert x != y and shared.bytes_hash(data, np.array([0]), np.array([n]))[0] == x
    for n in (3, 8, 32, 200, 1024):
        h = shared.gram_hash(data, n)
        same = np.array([(data[i : i + n] == data[2048 + i : 2048 + i + n]).all() for i in range(1000)])
        assert len(h) == 4096 - n + 1 and ((h[:1000] == h[2048:3048]) == same).all()
    start, size = np.arange(500), 200 + np.arange(500) % 190
    h = shared.gram_hash(data, 32)
    assert len(np.unique(shared.span_hash(h, start, start + size, 32))) == len({(data[a : a + n].tobytes()) for a, n in zip(start, size)})


def test_exact_with_splits(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("t "), (F.col("id") % 400).cast("string")).alias("text"))
    got = by_id(exact_dedup.exact_duplicates(docs, capacity=10, bits=8))
    assert {i: (x.keep_id, x.group_size) for i, x in got.items()} == {i: (i % 400, 2 if i % 400 < 200 else 1) for i in range(600)}
    keys, single, shared_rows = exact_dedup.split_rows(docs)
    slots = exact_dedup.directory(keys, 10, 8, load="n")
    assert slots.agg(F.max("depth") - F.min("depth")).first()[0] > 0
    slots = exact_dedup.with_owners(slots)
    index = exact_dedup.build_index(single, shared_rows, slots, 8)
    held = index.select("bucket", F.size("page").alias("n"))
    assert held.agg(F.sum("n")).first()[0] == 400 and held.count() > 40 and held.agg(F.max("n")).first()[0] <= 10
    rows = single.drop("text_sha256").unionByName(shared_rows)
    assert exact_dedup.look_up(rows, index, slots, 8).count() == 600
    # Without the directory's word a document's entry isn't found.
    assert exact_dedup.look_up(rows, index, slots.withColumn("bucket", F.col("slot")), 8).count() < 300


@pytest.mark.parametrize("owner_rows, slots", ((1 << 16, 1 << 20), (7, 0)))
def test_exact_with_collisions(spark, monkeypatch, owner_rows, slots):
    """Eleven keys for all texts, pages that a few texts fill, rows of a bucket with many owners, a directory that isn't broadcast."""
    for name, value in (("OWNER_ROWS", owner_rows), ("BROADCAST_SLOTS", slots), ("BROADCAST_KEYS", slots), ("PAGE_BYTES", 2000)):
        monkeypatch.setattr(exact_dedup, name, value)
    hashed = lambda norm: F.shiftleft(F.pmod(F.xxhash64(norm), F.lit(11)), 55)
    texts = [f"text {i % 90}" for i in range(300)] + ["long " * 900] * 40 + [None, "", "alone"]
    docs = table(spark, texts)
    got = by_id(exact_dedup.exact_duplicates(docs, capacity=2, bits=12, hashed=hashed))
    for i, t in enumerate(texts):
        same = [j for j, u in enumerate(texts) if (u or "") == re.sub(" +$", " ", t or "")]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (same[0], len(same), i == same[0])


def test_exact_keeps_one_row_of_tied_ids(spark):
    docs = odd_ids(spark, [(5, "a b"), (5, "a  b"), (5, "other"), (9, "a b"), (None, "n"), (None, "n"), (None, "n"), (None, "other")])
    got = exact_dedup.exact_duplicates(docs).collect()
    kept = sorted((x.keep_id or 0, x.doc_id or 0, x.group_size) for x in got if x.kept)
    assert len(got) == 8 and kept == [(0, 0, 3), (5, 5, 2), (5, 5, 3)]


def mcd(x, prior):
    """A plain minimum covariance determinant of one group, by the operator's starts, bins and regularisation."""
    p, (i, j) = 5, np.array(quality.PAIRS).T
    n, ridge = len(x), np.diag(np.square(quality.RIDGE))
    at = lambda q: np.sort(x, axis=0)[int(np.ceil(q * n)) - 1]
    m, w = at(0.5), np.maximum((at(0.75) - at(0.25)) / 1.349, quality.RIDGE)
    z, s = (x - m) / w, np.diag(w)
    u, t = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9), np.tanh(z)
    cov = lambda v: v.T @ v / len(v) - np.outer(v.mean(0), v.mean(0))

    def shrunk(held, c, v):
        if prior is None:
            return c, v + ridge
        a = held / (held + quality.PRIOR)
        return a * c + (1 - a) * prior[0], a * v + (1 - a) * prior[1] + a * ridge

    best = None
    for c, v in ((m, s @ s), (x.mean(0), cov(x)), (m, s @ (u.T @ u / n * p) @ s), (m, s @ cov(t) @ s)):
        (c, v), det = shrunk(n, c, v), np.inf
        while True:
            d = np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(v), x - c)
            bin_ = np.floor(np.log2(1 + d) * quality.BINS)
            inner = x[bin_ <= np.sort(bin_)[int(np.ceil(quality.INNER * n)) - 1]]
            c2, v2 = shrunk(len(inner), inner.mean(0), quality.CONSISTENCY * cov(inner))
            new = np.linalg.slogdet(v2)[1]
            if not new < det - 1e-6:
                break
            c, v, det = c2, v2, new
        if best is None or det < best[0] - 1e-7:
            best = (det, c, v)
    return best[1], best[2]


def test_quality_against_plain_estimates(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        lang, source = ("en", "s1") if i < 500 else ("de", None) if i < 893 else (None, "s2")
        x = rng.normal([5, 1.6, 0.1, 0.1, 0.05], [1, 0.1, 0.05, 0.1, 0.05]) if rng.random() < 0.85 else rng.normal([5, 2.2, 1.5, 0.5, 0.4], 0.3)
        rows.append((lang or "", source or "", *(np.round(np.abs(x) * 32) / 32).tolist()))
    docs = spark.createDataFrame([(a + b, *x) for a, b, *x in rows], "key string, " + ", ".join(f"{s} double" for s in quality.STATS))
    got = {x.key: x for x in quality.estimates(docs).collect()}
    every = mcd(np.array([x[2:] for x in rows]), None)
    for key in got:
        c, v = mcd(np.array([x[2:] for x in rows if x[0] + x[1] == key]), every)
        assert np.allclose([got[key][f"c{i}"] for i in range(5)], c, atol=1e-6)
        assert np.allclose(quality.square([got[key][f"s{i}"] for i in range(15)]), v, atol=1e-6)
    assert len(got) == 3


def test_quality_counts():
    got = quality.counts_of(pa.array(TEXTS))
    for i, t in enumerate(TEXTS):
        w = re.findall(WORD, t or "")
        windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (t or "").split("\n") if re.search(WORD, x)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(again))
        assert tuple(int(got[k][i]) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want


def test_spread_join(spark, monkeypatch):
    """With more keys than may be broadcast, those of many rows are and the others are shuffled; the joined rows are the same."""
    rows = spark.createDataFrame([("big", float(i)) for i in range(90)] + [(f"k{i % 10}", float(i)) for i in range(60)] + [("none", 0.0), (None, 0.0)], "key string, x double")
    side = shared.stored(rows.filter("key <> 'none'").groupBy("key").agg(F.count("*").alias("n"), F.max("x").alias("most")), "groups")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(side, "key", how).collect()))
        for limit in (1, 4, 100):
            monkeypatch.setattr(shared, "HOT_KEYS", limit)
            assert sorted(map(str, shared.spread_join(rows, side, "key", how).collect())) == want


def test_quality_verdict(spark):
    clean = [" ".join(r.choice(["tree", "house", "river", "stone", "cloud"]) + str(r.randint(0, 999)) for _ in range(60)) for _ in range(80)]
    junk = [" ".join(f"w{r.randint(0, 9999)}$$$" for _ in range(60)) for _ in range(4)]
    got = by_id(quality.verdicts(table(spark, clean + junk)))
    assert all(got[i].kept for i in range(80)) and not any(got[i].kept for i in range(80, 84))


def test_language(spark):
    words = {"en": "the of and house with them", "de": "der und nicht schön über ein", None: "the"}
    texts = [" ".join(r.choice(words[("en", "de", None)[i % 3]].split()) for _ in range(30)) for i in range(60)] + [None, "", "12 34"]
    docs = table(spark, texts)
    got = by_id(language_id.predicted(docs, *language_id.prototypes(docs)))
    assert all(got[i].lang_pred == ("en", "de", "en")[i % 3] for i in range(60)) and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (60, 61, 62))


def test_language_many_grams():
    """A text with more distinct trigrams than vectors are held at once, among short texts."""
    long = "".join(chr(r.randint(0x4E00, 0x9FFF)) for _ in range(100_000))
    ours = language_id.Letters()
    got, n = ours.bundle(["the house", long, None, long[:50]])
    s = np.append(ours.symbols[[ord(x) for x in long]], 0).astype(int)
    codes, count = np.unique(s[2:] | s[1:-1] << 8 | s[:-2] << 16, return_counts=True)
    assert len(codes) > language_id.MOST_GRAMS >= len(ours.grams) and n.tolist() == [8, 100_000, 0, 50]
    want = np.zeros(language_id.DIMENSIONS)
    for a in range(0, len(codes), 10_000):
        v = np.ones((len(codes[a : a + 10_000]), language_id.DIMENSIONS), int)
        for place in range(3):
            v *= np.roll(ours.vectors[codes[a : a + 10_000] >> (8 * (2 - place)) & 255], place, axis=1)
        want += count[a : a + 10_000] @ v
    assert np.allclose(got[1], want / np.linalg.norm(want), atol=1e-6)
    for i, t in ((0, "the house"), (3, long[:50])):
        assert np.allclose(got[i], language_id.Letters().bundle([t])[0][0], atol=1e-6)


def plain_line_dedup(texts, least=1):
    """Deletes what the longest earlier copy of a run covers, where runs begin and end with a word and have `least` lines with one."""
    lines = [t.split("\n") if t is not None else [] for t in texts]
    seen, out = set(), []
    for x in lines:
        gone, word = set(), [bool(re.search(WORD, y)) for y in x]
        for i in range(len(x)):
            for j in range(i + 1, len(x) + 1):
                run = tuple(x[i:j])
                if word[i] and word[j - 1] and sum(word[i:j]) >= least and run in seen:
                    gone.update(range(i, j))
                seen.add(run)
        out.append([y for k, y in enumerate(x) if k not in gone])
    return out


@pytest.mark.parametrize("least", (1, 2, 3, 5, 8))
def test_lines(spark, least):
    nine = [f"line {i}" if i % 4 else "" for i in range(1, 10)]
    more = ["\n".join(nine), "x\n" + "\n".join(nine[2:7]) + "\ny", "\n".join(nine) + "\nz", "a\n\nb\n\n\nc", "a\n\nb\n\nc", "q\n\n\nq", "b\n\n\nc\n", "a\n \nb", "one line that stands alone", "k\none line that stands alone\nm"]
    more += ["\n".join(r.choice(["u", "v", "", " ", "w w"]) for _ in range(r.randint(1, 14))) for _ in range(30)]
    texts = TEXTS + more
    got = by_id(line_dedup.drop_lines(table(spark, texts), least))
    assert {i: x.kept for i, x in got.items()} == dict(enumerate(plain_line_dedup(texts, least)))


def test_line_runs(spark):
    """A run of 5 lines nested in one of 9 is one maximal run of each copy; the least run decides what counts."""
    nine = [f"line {i}" for i in range(9)]
    texts = ["\n".join(nine), "\n".join(["x", *nine[2:7], "y"]), "\n".join(["z", *nine, *nine[:2]])]
    runs = {n: [[tuple(x) for x in d.runs] for _, d in sorted(by_id(line_dedup.drop_lines(table(spark, texts), n)).items())] for n in (1, 3, 6, 10)}
    assert runs == {1: [[], [(1, 5)], [(1, 11)]], 3: [[], [(1, 5)], [(1, 9)]], 6: [[], [], [(1, 9)]], 10: [[], [], []]}


def test_many_equal_lines(spark):
    n = 50_000
    got = by_id(line_dedup.drop_lines(table(spark, ["same\n" * n, "other"])))
    assert got[0].kept == ["same", ""] and [tuple(x) for x in got[0].runs] == [(1, n - 1)] and got[1].kept == ["other"]


@pytest.mark.parametrize("run", (lambda d: line_dedup.drop_lines(d), lambda d: substring_dedup.without_repeats(d), lambda d: suffix_dedup.without_repeats(d)))
def test_null_ids_take_part(spark, run):
    """Texts of rows without an id are compared; they come after all rows with one."""
    text = " ".join(f"word{i}" for i in range(40))
    docs = spark.createDataFrame([(None, text, "en", "s"), (None, "lone " + text, "en", "s"), (5, text, "en", "s"), (6, None, "en", "s")], NEEDED)
    rows = sorted(run(docs).collect(), key=lambda x: (x.doc_id is None, x.doc_id or 0))
    kept = [x.kept if not isinstance(x.kept, list) else "\n".join(x.kept) for x in rows]
    kept = [x.decode() if isinstance(x, (bytes, bytearray)) else x for x in kept]
    assert [x.doc_id for x in rows] == [5, 6, None, None]
    if "n_bytes" in rows[0]:
        assert kept[0] == kept[1] == "" and sorted(kept[2:]) in (["", "lone "], ["", "lone"])
    elif "n_words" in rows[0]:
        assert kept[0] == text and sorted(kept[1:]) == ["", "", "lone"]
    else:
        assert kept[0] == text and sorted(kept[1:]) == ["", "", "lone " + text]


def test_word_windows(spark):
    got, seen = by_id(substring_dedup.without_repeats(table(spark))), {}
    for i, t in enumerate(TEXTS):
        w = re.findall(WORD, t or "")
        gone = set()
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                gone.update(range(k, k + 20))
            seen.setdefault(tuple(w[k : k + 20]), (i, k))
        assert (got[i].n_words, got[i].n_removed, got[i].kept) == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))


@pytest.mark.parametrize("most,rounds", ((2048, 6), (1, 1), (1, 3)))
def test_byte_windows(spark, monkeypatch, most, rounds):
    """By blocks, by counts, and by other anchors before that."""
    monkeypatch.setattr(suffix_dedup, "MOST_CONTEXTS", most)
    monkeypatch.setattr(suffix_dedup, "ROUNDS", rounds)
    data = [(t or "").encode() for t in TEXTS]
    count = Counter(b[k : k + 200] for b in data for k in range(len(b) - 199))
    got = by_id(suffix_dedup.without_repeats(table(spark)))
    for i, b in enumerate(data):
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 199):
            if count[b[k : k + 200]] > 1:
                gone[k : k + 200] = True
        spans = int((np.diff(np.append(0, gone.astype(int))) == 1).sum())
        assert (got[i].n_removed, got[i].n_spans, bytes(got[i].kept)) == (int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone]))


def test_suffix_array():
    for _ in range(200):
        x = np.array([r.randint(1, r.choice([1, 2, 5, 200])) for _ in range(r.randint(0, 60))], int)
        assert suffix_dedup.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


def test_personal_data(spark):
    got = by_id(pii.personal_data(table(spark)))
    i = next(k for k, t in enumerate(TEXTS) if t and "joe.doe" in t)
    assert (got[i].n_email, got[i].n_ip, got[i].n_phone) == (1, 1, 0)  # the phone pattern runs on into the address and fails
    assert got[i].base_sha256 == sha("email:11:30,ip:52:67") and got[i].spans.startswith("email:11:30")
    assert (got[i + 1].n_card, got[i + 1].n_ip) == (1, 0)


def naive_base(text):
    """The contract's patterns, read plainly."""
    spans = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            luhn = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m.group().split(".")) or kind == "card" and 12 <= len(d) <= 19 and luhn or kind == "phone" and 9 <= len(d) <= 15:
                spans.append((m.start(), m.end(), kind))
    return sorted(spans, key=lambda x: (x[0], pii.KINDS.index(x[2])))


def test_personal_data_base():
    for _ in range(4000):
        t = "".join(r.choice(["1", "4", "25", "0.", ".", "@", "a", "b.c", "-", " ", "+", "(", ")", "4111 1111 1111 1111", "10.0.0.1", "%x", "é"]) for _ in range(r.randint(0, 30)))
        assert pii.found_spans(t)[0] == naive_base(t), t


def test_personal_data_long_runs(spark):
    """Long stretches of one kind of character take linear time, and a part of an address may have any number of digits."""
    long = ["0" * 5000 + ".1.1.1", "a" * 2_000_000 + "@", "a@" * 300_000, "1" * 1_000_000 + "-1.1.1.1", "1." * 500_000, "+" + "(" * 500_000, "(at" * 100_000, "a1" * 500_000, ""]
    got = by_id(pii.personal_data(table(spark, long)))
    assert got[0].n_ip == 1 and got[0].spans == "ip:0:5006" and got[3].n_ip == 1 and [got[i].n_email for i in (1, 2)] == [0, 0]


def test_personal_data_model(spark):
    """Expectation-maximisation against a plain one over each span, and credentials apart from the four kinds."""
    texts = [f"my phone +1 ({i}) 555-{1000 + i} and token = \"{hashlib.sha1(str(i).encode()).hexdigest()}\" end" for i in range(100, 160)] + ["order 1234567890123456 serial 99 a1b2c3d4e5f6g7h8i9 word"] * 20
    docs = table(spark, texts)
    got = by_id(pii.personal_data(docs))
    assert all(x.secrets.startswith("secret:") and x.n_found >= 2 for i, x in got.items() if i < 60) and all(x.n_found == 0 for i, x in got.items() if i >= 60)
    rows = pii.vote_table(docs)
    assert sum(n for k, _, n in rows if k == "phone") == 60
    model = pii.SpanModel(rows)
    one_by_one = pii.SpanModel([(k, v, 1) for k, v, n in rows for _ in range(n)])
    for k, v, _ in rows:
        assert abs(model.probability(k, v) - one_by_one.probability(k, v)) < 1e-6


def test_pieces(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())
    ours = piece_codec.codec(piece_codec.model_path())
    more = ["".join(r.choice(" abcdeotinhsr  ▁\nAÉß.,01日😀") for _ in range(r.randint(0, 40))) for _ in range(500)]
    for t in [*(t or "" for t in TEXTS), *more, "\x00a", "<s>hi</s>", "\tq"]:
        ids = library.encode(t, add_eos=True)
        assert ours.encode(t) == ids and ours.decode(ids) == library.decode(ids)
    got = by_id(piece_codec.token_digests(table(spark)))
    assert got[0].ids_sha256 == sha(" ".join(map(str, library.encode(TEXTS[0], add_eos=True)))) and got[0].decoded_sha256 == sha(TEXTS[0])
    again = by_id(piece_codec.decoded(piece_codec.encoded(table(spark))))
    assert again[5].text == TEXTS[5]


def test_pieces_by_table(monkeypatch):
    """Digests by a table of chunks equal the library's while it fills again and again; chunks that come again are encoded once."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_codec.model_path())
    monkeypatch.setattr(piece_codec, "TABLE_BYTES", 120_000)
    monkeypatch.setattr(piece_codec, "STRIDE", 50)
    monkeypatch.setattr(piece_codec, "KNOWN_PAIRS", 300)
    ours, asked = piece_codec.PieceCodec(piece_codec.model_path()), Counter()
    encode = ours.encode_chunk
    monkeypatch.setattr(ours, "encode_chunk", lambda c: asked.update([c]) or encode(c))
    r = random.Random(9)
    rare = lambda: "".join(r.choice("abcdeghilnorstuéßЖд") for _ in range(r.randint(3, 14)))
    often = ["representations", "Gedächtnis", "counterexample", "élémentaire"]
    texts = [" ".join([*often, *(rare() + r.choice(["", ",", "...", "!?", "5.2", "日本", "\r", "\x00"]) for _ in range(60))]) for _ in range(40)]
    texts += ["", " ", "\n", "▁▁ a▁b", "  two  spaces ", "<s>hi</s>", " 5 55", "x" * 70 + " " + "ab." * 50, "日本語" * 40, "ab" * 300 + "\n\n" + " " * 80 + "é😀Č Є"]
    r.shuffle(texts)
    for t, (n, ids_sha256, decoded_sha256) in zip(texts, [x for b in piece_codec.bundles(texts) for x in ours.digests(b)], strict=True):
        ids = library.encode(t, add_eos=True)
        assert (n, ids_sha256, decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    assert len(asked) > 1000 and max(map(len, [*ours.table, *ours.old])) <= piece_codec.LONG_CHUNK
    assert ours.held < piece_codec.TABLE_BYTES and sum(len(c) for c in [*ours.table, *ours.old]) < piece_codec.TABLE_BYTES
    assert [asked[" " + w] for w in often] == [1, 1, 1, 1]
    asked.clear()
    ours.digests(["Wohnungen Wohnungen, Wohnungen. Wohnungen! Wohnungen... Wohnungen"])
    assert asked[" Wohnungen"] == 1 and not any("Wohnungen" in c for c in asked if c != " Wohnungen")
    monkeypatch.setattr(piece_codec, "BUNDLE", 10)
    assert list(piece_codec.bundles(["abc", "", "defghij", "x" * 30, "k"])) == [["abc", "", "defghij"], ["x" * 30], ["k"]]


@pytest.mark.parametrize("run", (exact_dedup.exact_duplicates, mixing.mix_plan, near_dedup.near_duplicates, quality.verdicts, line_dedup.drop_lines, substring_dedup.without_repeats, suffix_dedup.without_repeats, pii.personal_data, piece_codec.token_digests))
def test_empty_table_and_null_ids(spark, run):
    assert run(spark.createDataFrame([], NEEDED)).count() == 0
    odd = spark.createDataFrame([(None, "a b c", None, None), (None, None, None, None), (1, "a b c", "en", "s"), (1, "a b c", "en", "s")], NEEDED)
    assert run(odd).count() == 4


def odd_ids(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s") for i, t in rows], NEEDED)


def texts_of(df):
    return sorted(x.text for x in df.select("text").collect())


def test_quality_keeps_rows_of_odd_ids(spark):
    clean = [" ".join(r.choice(["tree", "house", "river", "stone", "cloud"]) + str(r.randint(0, 999)) for _ in range(60)) for _ in range(80)]
    junk = [" ".join(f"w{r.randint(0, 9999)}$$$" for _ in range(60)) for _ in range(4)]
    ids = [*(None,) * 10, *range(70)]
    docs = odd_ids(spark, [*zip(ids, clean), *zip((None, None, 5, 6), junk)])
    assert texts_of(quality.kept_documents(docs)) == sorted(clean)


def test_exact_keeps_one_of_each_text(spark):
    docs = odd_ids(spark, [(None, "a b"), (None, "a  b"), (None, "lone"), (7, "a b c"), (7, "other"), (3, "a b c"), (3, "a b c"), (3, "a  b c"), (None, None), (4, "")])
    got = sorted((x.doc_id is None, x.doc_id or 0, re.sub(r"\s+", " ", x.text or "")) for x in exact_dedup.deduplicated(docs).collect())
    assert got == [(False, 3, "a b c"), (False, 4, ""), (False, 7, "other"), (True, 0, "a b"), (True, 0, "lone")]


def test_near_keeps_one_of_each_component(spark):
    a, b, c = (" ".join(str(r.randint(0, 9999)) for _ in range(60)) for _ in range(3))
    near = [x + " tail" for x in (a, b, c)]
    docs = odd_ids(spark, [(None, a), (None, near[0]), (None, b), (2, near[1]), (2, "on its own and of the same id"), (9, c), (9, near[2]), (9, c), (None, ""), (None, "")])
    got = Counter(texts_of(near_dedup.one_of_each(docs)))
    assert got[a] + got[near[0]] == 1 and (got[b], got[near[1]]) == (0, 1) and got[c] + got[near[2]] == 1
    assert got[""] == 2 and got["on its own and of the same id"] == 1 and sum(got.values()) == 6


def test_mixed_counts_rows_of_odd_ids(spark):
    texts = [f"w{i} x y" for i in range(40)]
    docs = odd_ids(spark, [*((None, t) for t in texts), (1, "p q r"), (1, "p q s"), *[(2, "same same same")] * 6])
    plan = [x.copies for x in mixing.mix_plan(docs, by_row=True).collect()]
    got = Counter(texts_of(mixing.mixed(docs)))
    assert len(set(plan)) > 1 and sum(got.values()) == sum(plan) and set(got[t] for t in texts) == {1, 2}


def test_stages_keep_rows_of_odd_ids(spark):
    import corpus_pipeline

    clean = [" ".join(r.choice(["tree", "house", "river", "stone", "cloud"]) + str(r.randint(0, 999)) for _ in range(60)) for _ in range(80)]
    junk = [" ".join(f"w{r.randint(0, 9999)}$$$" for _ in range(60)) for _ in range(4)]
    docs = odd_ids(spark, [*zip([None, 1, None, 1, *range(76)], clean), (None, junk[0]), (1, junk[1]), (None, clean[0]), (1, clean[1]), (None, clean[2] + " tail")])
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, None)
    left = texts_of(docs)
    assert len(left) == 80 and set(left) <= {*clean, clean[2] + " tail"}
    mix = corpus_pipeline.STAGES[3][1](spark, docs, None)
    assert corpus_pipeline.STAGES[4][1](spark, mix, None).count() == mix.count() == sum(x.copies for x in mixing.mix_plan(docs, by_row=True).collect())


def test_language_held_out(spark):
    """Documents that were not learnt from, of the given tables."""
    sf = "/root/testdata/sf0.001"
    found = language_id.op3_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = [(x.lang, x.lang_pred) for x in found.filter("held_out AND lang IS NOT NULL").collect()]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.95 * len(held)


def test_language_of_empty_tables_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id.predicted(empty, *language_id.prototypes(empty)).count() == 0
    rows = [(None, "the house", "en"), (None, None, "en"), (1, "", None), (1, "das Haus", "de")]
    docs = spark.createDataFrame(rows, empty.schema)
    got = sorted((x.doc_id or 0, x.lang_pred) for x in language_id.predicted(docs, *language_id.prototypes(docs)).collect())
    assert got == [(0, "en"), (0, "und"), (1, "de"), (1, "und")]
    # Without anything to learn from, every text is undetermined.
    assert {x.lang_pred for x in language_id.predicted(docs, *language_id.prototypes(docs.filter("lang = 'xx'"))).collect()} == {"und"}


@pytest.mark.parametrize("step", [quality.text_counts, near_dedup.set_table, piece_codec.token_digests])
def test_batches_are_bounded_by_bytes(spark, step):
    """600 texts of 40,000 bytes would be one batch of 24 MB by Spark's own limits; a limit of the session stays."""

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    long = spark.range(0, 600, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 8000).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    assert step(long).count() == 600
    got = long.mapInArrow(sizes, "n long, size long").collect()
    assert sum(x.n for x in got) == 600 and max(x.size for x in got) <= 5 << 20
    spark.conf.set(limit, "1m")
    step(long)
    assert spark.conf.get(limit) == "1m"
    spark.conf.unset(limit)


def test_parts_of_batches():
    batch = pa.RecordBatch.from_arrays([pa.array(range(10))], names=["x"])
    assert [p.column(0).to_pylist() for p in shared.parts_of(batch, 4)] == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    assert not list(shared.parts_of(batch.slice(0, 0)))
