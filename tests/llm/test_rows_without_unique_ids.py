"""Null and repeated ids: nodes that ids cannot name."""

from collections import Counter

from pyspark.sql import functions as F

from bandloom.llm import embeddings, mixing, simhash


def test_unnamed_codes_do_not_join_unrelated_documents(spark, monkeypatch):
    # The text is its own fingerprint here: 5 and 9 each have an unnamed neighbour, two more are alone.
    monkeypatch.setattr(simhash, "fingerprint", lambda text: F.conv(text, 16, 10).cast("bigint"))
    rows = [(5, "FF00"), (None, "FF01"), (9, "00FF0000"), (None, "00FF0001"), (None, "7777000000000000"), (None, "7777000000000001"), (None, "0F0F0F0F00000000")]
    got = simhash.simhash_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert {r.fingerprint: (r.doc_id, r.component_id) for r in got} == {
        f"{int(text, 16):016x}": (doc, component) for (doc, text), component in zip(rows, [5, 5, 9, 9, None, None, None])
    }


def test_vectors_under_one_id_have_links_of_their_own(spark):
    a, b, c = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], [0.0, 0.0, 1.0, 0.0]
    near = lambda v: [x + 0.01 for x in v]
    rows = [(5, a, 1), (5, b, 1), (5, c, 1), (6, near(a), 1), (7, near(b), 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got = Counter(map(tuple, embeddings.near_vectors(df).collect()))
    assert got == Counter([(5, 1, 5, True), (5, 1, 5, True), (5, 0, 5, True), (6, 1, 5, False), (7, 1, 5, False)])
