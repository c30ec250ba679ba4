"""Training order of rows that ids cannot find."""

from collections import Counter

from cases import DOCUMENTS, prose, words

from bandloom.llm import mixing


def test_training_order_keeps_rows_without_unique_ids(spark):
    rows = [(i, prose(i, 20 + i % 50), "en", "abc"[i % 3], 1) for i in range(60)]
    rows += [(None, prose(100 + i, 30), "en", "abc"[i % 3], 1) for i in range(9)] + [(7, prose(200 + i, 30 + i), "en", "a", 1) for i in range(4)]
    rows += [(8, prose(300, 25), None, "b", 1)] * 3 + [(9, prose(301, 25), "a", None, 1), (9, prose(301, 25), None, "a", 1)]
    docs = spark.createDataFrame(rows, DOCUMENTS).repartition(3, "n_chars")
    mixed = mixing.mix_sources(docs)
    out = mixing.training_order(docs, mixed).collect()
    took = [r for r in mixed.collect() if r.taken > 0]
    assert len(out) == sum(t > 0 for r in took for t in r.takes)
    assert Counter((r.doc_id, len(words(r.text))) for r in out) == Counter((r.doc_id, t) for r in took for t in r.takes if t > 0)
    texts = {}
    for doc, text, lang, source, _ in rows:
        texts.setdefault((doc, lang, source), []).append(" ".join(words(text)))
    assert all(any(t.startswith(" ".join(words(r.text))) for t in texts[(r.doc_id, r.lang, r.source)]) for r in out)
    assert sum(r.doc_id is None for r in out) > 0 and max(Counter(tuple(r) for r in out).values()) <= 9
