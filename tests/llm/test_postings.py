"""Benchmark passages against a direct search of every window in every document."""

import random
import re
from collections import defaultdict

import pytest
from cases import documents, no_documents, prose
from pyspark.sql import functions as F

from bandloom.llm import postings

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = "item_id bigint, text string"


def folded(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, window=10, slop=0):
    windows = defaultdict(set)
    for item, text in items:
        w = folded(text)
        for i in range(max(len(w) - window, 0) + 1) if w else []:
            windows[tuple(w[i : i + window])].add(None if item is None else str(item))
    out = []
    for doc, text in docs:
        w = folded(text)
        there = set(enumerate(w))
        hit, owners, near = set(), set(), set()
        for g, who in windows.items():
            for start in range(-slop - len(g), len(w) + slop):
                if all(any((start + k + off, x) in there for off in range(-slop, slop + 1)) for k, x in enumerate(g)):
                    near |= who
                    if tuple(w[max(start, 0) : start + len(g)]) == g and start >= 0:
                        hit |= set(range(start, start + len(g)))
                        owners |= who
        out.append((doc, len(w), len(hit), sorted(owners - {None}), sorted(near - {None})))
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    rows = postings.contaminated_documents(docs, spark.createDataFrame(items, ITEMS), **options).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["near_items"]) for r in rows), key=str)


def corpus():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)] + ["Straße", "é", "naïve"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(12 + i % 9)) for i in range(14)] + [(20, "short One"), (21, "lone"), (22, ""), (23, None), (24, "  !! "), (3, say(11)), (None, say(13))]
    items += [(30, items[0][1]), (31, items[0][1] + " tail")]
    docs = []
    for i in range(60):
        parts = [say(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split(" ")
            if rng.random() < 0.4:
                w.insert(rng.randrange(len(w) + 1), "extra")
            at = rng.randrange(len(w))
            parts += [rng.choice([", ", "\n", "-"]).join(w[at // 3 :]).upper().replace("É", "é").replace("Ï", "ï").replace("SSE", "ße"), say(rng.randrange(12))]
        docs.append((i, " ".join(parts)))
    return docs + [(3, docs[3][1]), (None, docs[4][1]), (None, items[1][1]), (70, None), (71, ""), (72, "LONE"), (73, items[0][1][:-3])], items


@pytest.mark.parametrize("options", [{}, {"block_words": 100}, {"chunk_windows": 7}, {"window": 4, "chunk_windows": 20, "block_words": 300}])
def test_exact(spark, options):
    docs, items = corpus()
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = found(spark, table, items, **options)
    assert got == brute(docs, items, options.get("window", 10)) and sum(r[2] for r in got) > 100


@pytest.mark.parametrize("slop", [1, 3])
def test_proximity(spark, slop):
    docs, items = corpus()
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(2)
    got = found(spark, table, items, window=5, slop=slop, block_words=200)
    assert got == brute(docs, items, 5, slop) and any(r[3] != r[4] for r in got)


def test_all_words_are_kept_beyond_the_vocabulary_limit(spark, monkeypatch):
    monkeypatch.setattr(postings, "VOCABULARY", 3)
    monkeypatch.setattr(postings, "_CANDIDATES", 10)
    docs, items = corpus()
    assert found(spark, spark.createDataFrame(docs, "doc_id bigint, text string"), items) == brute(docs, items)


def test_awkward_documents(spark):
    docs = documents(spark, clashing=True).withColumns({"block": F.lit(1), "doc": F.lit(1), "items": F.lit("x"), "n_hit": F.lit(0)})
    items = [(1, prose(1, 300)), (2, "a b c"), (3, "one"), (4, "same line here same line"), (5, "ünïcode 😀"), (6, prose(5, 60))]
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found(spark, docs, items) == brute(plain, items)


def test_empty_tables(spark):
    docs, items = corpus()
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert all(r[2] == 0 and not r[3] for r in found(spark, table, []))
    assert len(found(spark, table, [])) == len(docs) == len(found(spark, table, [(1, None), (2, "?")]))
    assert found(spark, no_documents(spark), items) == []
