"""Small awkward tables and brute-force versions shared by the tests."""

import random
import re

from pyspark.sql import functions as F

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
# Names that operators might use inside; they must come through unharmed or be ignored.
CLASHING = ["id", "row", "place", "key", "size", "code", "node", "_words", "_lang", "time", "take", "pass", "src", "one", "rank", "vector", "conv", "at"]


def words(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{int(rng.paretovariate(0.9)) % vocabulary}{rng.choice(['', '', '.', ','])}" for _ in range(n))


def document_rows():
    base, passage = prose(1, 300), prose(2, 70)
    near = base.split(" ")
    near[40] = "changed"
    rows = [
        (10, base, "en", "b", 5), (11, base, "en", "b", 5), (12, " ".join(near), "en", "a", None), (13, passage + "\n" + prose(3, 60), "en", None, 1),
        (14, prose(4, 55) + "\t" + passage, None, "a", 0), (15, passage[: len(passage) // 2], "de", "", 3), (16, None, "en", "a", None), (17, "", "en", "b", 0),
        (18, " \n\t \x0b\x0c\r ", "fr", "a", 4), (19, "one", "fr", "c", 3), (20, "One TWO", "fr", "c", 7), (21, "one two", None, None, None),
        (22, "é à ß x " * 30, "de", "c", 2), (23, "same line here\n" * 40, "en", "b", 9), (24, "a b c " * 3000, "en", "a", 1),
        (25, prose(5, 9000), "en", "a", 1), (25, prose(5, 9000), "en", "a", 1), (None, prose(6, 80), "en", "b", 2), (None, base, None, None, None),
        (30, "Ünïcode 😀 " * 20 + "#$%& | <x> ***", "es", "d", 2), (31, prose(7, 120) + "\n" + base, "en", "b", 3), (-5, passage, "en", "b", 3),
    ]
    return rows


def documents(spark, clashing=False):
    df = spark.createDataFrame(document_rows(), DOCUMENTS).repartition(3, "n_chars")
    if clashing:
        df = df.withColumns({c: F.lit(f"mine {c}") for c in CLASHING})
    return df


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


def components(nodes, links):
    """Smallest node reachable from each."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
