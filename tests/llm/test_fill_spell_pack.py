"""Operators 11 to 13 against plain versions, on texts with nulls, ties, repeated rows and clashing columns."""

import hashlib
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import zstandard

from pitwell.llm import fill_middle, packing, spelling

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
r = random.Random(5)
TEXTS = [None, "", " ", "\n\t ", "a", " a", "a ", "one two  three\n", "holds a <S> mark", "é ß ü 漢字 　x", "x" * 400, " " * 300 + "y" * 300 + " " * 300]
TEXTS += ["".join(r.choice(["a", "é", "漢", " ", "  ", "\n", "long" * 9]) for _ in range(n)) for n in range(2, 90)]
EXTRA = ", frames int, units string, word string, n int, length string, offset int, sequence_id string, text_ string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "u", "w", 2, "l", 3, "s", None) for i, t in rows], "doc_id long, text string" + EXTRA)


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plain_fill(i, text):
    text = text or ""
    u = UNIT.findall(text)
    digest = sha(f"42:{'' if i is None else i}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if h[3] % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("size", [7, 64, fill_middle.FRAME_BYTES])
def test_fill_middle(spark, size):
    rows = [*enumerate(TEXTS), *((1000 + i, t) for i, t in enumerate(TEXTS)), (3, "again with this id"), (None, "no id at all"), (None, None), (7, TEXTS[7])]
    out = fill_middle.fill_in_middle(fill_middle.text_frames(table(spark, rows), size))
    got = Counter((x.doc_id, x.n, x.form, x.prefix_chars, x.middle_chars, x.output_sha256, x.restored_sha256) for x in out.collect())
    want = Counter((i, *(p := plain_fill(i, t))[:4], sha(p[4]), sha(t or "")) for i, t in rows)
    assert got == want and {x[2] for x in want} == {"plain", "spm", "psm"}
    texts = Counter((x.doc_id, x.form, x.text) for x in fill_middle.output_texts(out).collect())
    assert texts == Counter((i, plain_fill(i, t)[1], plain_fill(i, t)[4]) for i, t in rows)


def test_fill_middle_seeks():
    """Only the frames with a cut are decompressed to cut, and whole frames are passed on as they are."""
    text = " ".join(str(k) for k in range(5000)).encode()
    frames, units, chars, ends, _ = fill_middle.store_text(text, zstandard.ZstdCompressor(), 500)
    opened = []

    class Watched:
        def decompress(self, frame):
            opened.append(frames.index(frame))
            return zstandard.ZstdDecompressor().decompress(frame)

    stored = fill_middle.FramedText(frames, units, chars, ends)
    out, prefix, middle = fill_middle.transformed(stored, [1234, 3456, 0, 0], "spm", zstandard.ZstdCompressor(), Watched())
    assert len(set(opened)) <= 2 and sum(f in frames for f in out) >= len(frames) - 2
    assert prefix == len(" ".join(str(k) for k in range(1234))) and stored.n == 5000


def test_fill_middle_long_and_empty(spark):
    long = "word and  more\n" * 300_000
    out = fill_middle.fill_in_middle(fill_middle.text_frames(table(spark, [(k, long) for k in range(4)])), digests_only=True).collect()
    assert sorted((x.n, x.form, x.prefix_chars, x.middle_chars, x.output_sha256, x.restored_sha256) for x in out if x.form != "plain") == sorted((*(p := plain_fill(k, long))[:4], sha(p[4]), sha(long)) for k in range(4) if plain_fill(k, long)[1] != "plain")
    assert fill_middle.fill_in_middle(fill_middle.text_frames(table(spark, []))).count() == 0


def plain_variants(rows, least, least_count, factor, one_of):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_of == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= least and k >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    close = {w: [v for v in n if near(v, w)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in close.items() if vs}
    form = {w: best[w] if w in best and n[best[w]] >= factor * n[w] else None for w in n}

    def root(w):
        return root(form[w]) if form[w] else w

    return {(w, form[w], root(w), n[w], len(close[w]), n[form[w]] if form[w] else None) for w in n}


@pytest.mark.parametrize("seed", range(3))
def test_spelling(spark, seed):
    r = random.Random(seed)
    words = ["".join(r.choice("abÉé×z") for _ in range(r.randint(1, 6))) for _ in range(50)]
    words += ["a" * k for k in (3, 4, 5, 6, 70, 71)] + ["ab" * 32, "ab" * 32 + "a", "ab" * 31 + "a", "ab" * 31 + "aa", "x" + "ab" * 60, "y" + "ab" * 60, "ab" * 60, "aab" + "ab" * 59]
    texts = [" ".join(r.choices(words, [1 + 5 * (k % 7 == 0) for k in range(len(words))], k=40)) + r.choice(["", "-ÀB", "1a b2", "Łab"]) for _ in range(60)]
    rows = [*enumerate(texts), (None, texts[0]), (None, None), (2, texts[2]), (2, "abz abz"), (5, "")]
    for least, count, factor, one_of in ((2, 2, 2, 5), (3, 1, 5, 199), (1, 1, 1.5, 3)):
        got = [tuple(x) for x in spelling.variants(table(spark, rows), least, count, factor, one_of).select("word", "form", "root", "n", "n_near", "form_n").collect()]
        assert len(got) == len(set(got)) and set(got) == plain_variants(rows, least, count, factor, one_of)


def test_spelling_chain_and_empty(spark):
    """A chain of forms is followed to its end."""
    words = [("abcdef", 6), ("abcdeg", 30), ("abcdxg", 150), ("abyxxg", 1)]
    rows = [(1, " ".join(w for w, k in words for _ in range(k)))]
    got = {x.word: x for x in spelling.variants(table(spark, rows), 6, 5, 5, 1 << 31).collect()}
    assert got["abcdef"].form == "abcdeg" and {x.root for x in got.values()} == {"abcdxg"} and set(got) == {"abcdef", "abcdeg", "abcdxg"}
    assert spelling.variants(table(spark, [])).count() == 0


def test_checksums():
    data = np.frombuffer("".join(r.choice("abcé") for _ in range(900)).encode(), np.uint8)
    start = np.array([0, 5, 5, 100, 300])
    end = np.array([4, 5, 6, 290, 348])
    heads = np.array([crc32(b"%d:" % k) for k in range(5)], np.uint32)
    assert spelling.run_checksums(data, start, end, heads).tolist() == [crc32(data[a:b].tobytes(), int(h)) for a, b, h in zip(start, end, heads)]


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_ids(tokenizer):
    texts = [t or "" for t in TEXTS] + ["it's <|endoftext|> x<|endoftext|>", "a\u0085b 　 c\x1c\x1f d", "᠎ x  ᠎", " \r\n\r\n ", "🙂🙂 x", "don't 'sx ’s", "1234567 12,5"]
    texts += ["".join(chr(c) for c in range(a, a + 300) if not 0xD800 <= c < 0xE000) for a in range(1, 0x30000, 997)]
    for text in texts:
        assert packing.token_ids(text, packing.vocabulary_path()).tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def check_packing(rows, capacity):
    at = {}
    for x in rows:
        at.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for held in at.values():
        held.sort()
        assert [o for o, _ in held] == np.cumsum([0, *(n for _, n in held)])[:-1].tolist() and sum(n for _, n in held) <= capacity
    return len(at)


@pytest.mark.parametrize("capacity, group", [(64, 1 << 16), (64, 40), (2048, 10)])
def test_packing(spark, tokenizer, capacity, group):
    rows = [*enumerate(TEXTS), (None, "no id"), (None, "no id"), (4, TEXTS[40]), (4, TEXTS[40])]
    made = packing.pieces(table(spark, rows), capacity, with_ids=True)
    out = packing.packed(packing.stored(made, "t"), capacity, group, keep=3, fan=2).collect()
    want = Counter()
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        head = len(ids) % capacity or min(capacity, len(ids))
        for k, (a, b) in enumerate([(0, head), *((a, a + capacity) for a in range(head, len(ids), capacity))] if len(ids) > capacity else [(0, len(ids))]):
            want[i, k, a, b - a, crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((x.doc_id, x.piece, x.start, x.length, x.ids_crc32) for x in out) == want
    whole = len(packing.best_fit([x.length for x in out], capacity))
    assert check_packing(out, capacity) <= whole + (2 if len(out) > group else 0)


def test_packing_empty(spark):
    assert packing.packed(packing.stored(packing.pieces(table(spark, [])), "t")).count() == 0
    assert packing.sequences(table(spark, [])).count() == 0


def test_sequences(spark, tokenizer):
    got = packing.sequences(table(spark, [*enumerate(TEXTS)]), 64).collect()
    ids = Counter(i for t in TEXTS for i in [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])
    assert Counter(i for x in got for i in x.ids) == ids and all(0 < len(x.ids) <= 64 for x in got)


def optimum(lengths, capacity):
    """Fewest bins, by trying everything."""
    best = [len(lengths)]

    def place(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[k] <= capacity and bins[j] not in bins[:j]:
                place(k + 1, [*bins[:j], bins[j] + lengths[k], *bins[j + 1 :]])
        place(k + 1, [*bins, lengths[k]])

    place(0, [])
    return best[0]


def test_local_search():
    """Trades win over best fit, keep every piece, and come near the optimum."""
    r, better, over = random.Random(2), 0, 0
    for _ in range(150):
        lengths = sorted((r.randint(15, 50) for _ in range(9)), reverse=True)
        start = packing.best_fit(lengths, 100)
        out = packing.traded([list(b) for b in start], 100)
        assert Counter(x for b in out for x in b) == Counter(lengths) and max(map(sum, out)) <= 100
        used, least = sum(map(bool, out)), optimum(lengths, 100)
        assert least <= used <= len(start)
        better, over = better + (used < len(start)), over + (used > least)
    assert better and over <= 10
    triplets = [x for _ in range(300) for a, b in [(r.randint(520, 900), r.randint(400, 700))] for x in (a, b, 2048 - a - b)]
    start = packing.best_fit(triplets, 2048)
    assert sum(map(bool, packing.traded([list(b) for b in start], 2048))) - 300 < 0.6 * (len(start) - 300)


def test_each_kind_of_trade():
    move, one, two, out = [[60, 30], [70]], [[50, 30], [60, 35], [5]], [[40, 20], [70], [28, 30, 12]], packing.Trades
    t = out(move, 100)
    t.relieve(1)
    assert t.fill == [90, 70] or sum(t.fill) == 160
    t = out(one, 100)
    t.leave(2)
    assert t.trade(2, (5,), (0,)) and t.fill[1] == 100
    t = out(one := [[50, 30], [60, 25]], 100)
    t.leave(0)
    assert t.trade(0, (30,), (0, 1)) and t.fill == [75, 90] and sorted(one[1]) == [30, 60]
    t = out(two, 100)
    t.leave(0)
    assert t.trade(0, (40,), (1,)) is False or sum(t.fill) == 200
    t = out(pair := [[45, 20], [21, 22, 50]], 100)
    t.leave(0)
    assert t.trade(0, (45,), (1,)) and sorted(pair[1]) == [45, 50] and t.fill == [63, 95]
