"""Periodic runs against a direct scan of every period."""

import random

import numpy as np
import pytest
from cases import documents, no_documents, words
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bandloom.llm import runs


def brute_runs(w, min_length=6, exponent=4):
    found = {}
    for q in range(1, len(w) // exponent + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_length, exponent * q):
                found.setdefault((i, length), q)
            i = j
    return sorted((s, n, q) for (s, n), q in found.items())


def collapsed(w, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def fibonacci_word(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def check(word):
    numbers = {x: i for i, x in enumerate(dict.fromkeys(word))}
    symbols = np.array([numbers[x] for x in word], dtype=np.int64)
    assert [tuple(map(int, r)) for r in zip(*runs.find_runs(symbols))] == brute_runs(list(word))


@pytest.mark.parametrize("word", ["", "a", "aaaaa", "aaaaaa", "a" * 100, "ab" * 40, "abc" * 9 + "ab", "xabababababy" * 6, fibonacci_word(300), thue_morse(256),
                                  ("abcde" * 5 + "f") * 7, "aab" * 4 + "aabaabb" * 8, "b" + "a" * 64 + "b" + "a" * 63])
def test_known_words(word):
    check(word)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=9), st.integers(1, 9)), max_size=8))
def test_powers_beside_each_other(parts):
    check("".join(root * times for root, times in parts))


@settings(max_examples=100, deadline=None)
@given(st.text("ab", max_size=80))
def test_two_letters(word):
    check(word)


def test_wavelet_matrix_counts_and_selects():
    rng = np.random.default_rng(1)
    values = rng.permutation(100)
    tree = runs.WaveletMatrix(values)
    low = rng.integers(0, 99, 50)
    high = low + 1 + rng.integers(0, 100 - low)
    bound = rng.integers(0, 101, 50)
    assert tree.less(low, high, bound).tolist() == [int((values[a:b] < x).sum()) for a, b, x in zip(low, high, bound)]
    place = (rng.random(50) * (high - low)).astype(np.int64)
    assert tree.nth(low, high, place).tolist() == [int(np.sort(values[a:b])[p]) for a, b, p in zip(low, high, place)]


def test_documents(spark, monkeypatch):
    docs = documents(spark, clashing=True).withColumn("runs", F.lit("mine"))
    out = runs.mark_runs(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        w = words(r["text"])
        found = brute_runs(w) if len(w) < 2000 or r["doc_id"] == 24 else None
        if r["doc_id"] == 24:
            found = [(0, 9000, 3)]
        if found is not None:
            assert list(zip(r["runs"]["starts"], r["runs"]["lengths"], r["runs"]["periods"])) == found
            assert r["runs"]["collapsed"] == collapsed(w, found)
        assert r["runs"]["n_words"] == len(w) and r["id"] == "mine id"
    assert runs.mark_runs(no_documents(spark)).count() == 0


def test_parts_and_texts_beyond_a_part(monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("xyz") for _ in range(rng.randrange(40))) * rng.randrange(1, 6) for _ in range(60)] + [None, "", "a " * 500]
    whole = [row for split in runs._parts(texts) for row in runs._part_rows(split, 6, 4)]
    monkeypatch.setattr(runs, "_PART_WORDS", 50)
    small = [row for split in runs._parts(texts) for row in runs._part_rows(split, 6, 4)]
    assert len(whole) == len(texts)
    for a, b, t in zip(whole, small, texts):
        assert a[0] == b[0] and a[4] == b[4] and [x.tolist() for x in a[1:4]] == [x.tolist() for x in b[1:4]]
        assert list(zip(*(x.tolist() for x in a[1:4]))) == brute_runs(words(t))


def test_smaller_exponents_are_refused():
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(10, dtype=np.int64), min_exponent=3)


def test_greatest_run_ties(spark):
    text = "a a a a a a x " + "b b b b b b y " + "c d c d c d c d"
    row = runs.mark_runs(spark.createDataFrame([(text,), ("a b",)], "text string")).select(runs.greatest_run(F.col("runs")).alias("b"), runs.run_lines(F.col("runs")).alias("l")).collect()
    assert tuple(row[0]["b"]) == (14, 8, 2) and row[0]["l"] == "0,6,1\n7,6,1\n14,8,2\n"
    assert row[1]["b"] is None and row[1]["l"] == ""
