"""A doc_id on rows with different texts: marks of one row never touch another, whether or not some id is null."""

import hashlib
import random

import pytest

from pitwell.llm import line_dedup, substring_dedup, suffix_dedup

r = random.Random(3)
W, U = (" ".join(f"{r.randint(0, 10**6)}" for _ in range(40)) for _ in range(2))
OTHER = [[], [(None, "zz")], [(None, "zz"), (None, W)]]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("more", OTHER)
def test_words(spark, more):
    rows = [(0, W), (1, W), (1, U), (2, U), (2, U), *more]
    got = sorted(((x.doc_id, x.n_removed) for x in substring_dedup.without_repeats(docs(spark, rows)).collect() if x.doc_id is not None))
    assert got == [(0, 0), (1, 0), (1, 40), (2, 40), (2, 40)]


@pytest.mark.parametrize("more", OTHER)
def test_bytes(spark, more):
    a, b = ("".join(r.choice("abcdefgh") for _ in range(400)) for _ in range(2))
    rows = [(0, a), (1, a), (1, b), *more]
    got = sorted((x.doc_id, x.n_removed) for x in suffix_dedup.without_repeats(docs(spark, rows)).collect() if x.doc_id is not None)
    assert got == [(0, 400), (1, 0), (1, 400)]


@pytest.mark.parametrize("more", [[], [(None, "zz")]])
def test_lines(spark, more):
    rows = [(0, "x\ny"), (1, "x\ny"), (1, "p\nq"), (4, "q1\nk1"), (4, "a\nk\nb"), (4, "q\n\nz"), *more]
    got = sorted((x.doc_id, "\n".join(x.kept)) for x in line_dedup.drop_lines(docs(spark, rows)).collect() if x.doc_id is not None)
    assert got == [(0, "x\ny"), (1, ""), (1, "p\nq"), (4, "\nz"), (4, "a\nk\nb"), (4, "q1\nk1")]  # q stands in the second row of id 1
