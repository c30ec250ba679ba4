"""Pipeline stages carry columns whose names they use themselves."""

from cases import DOCUMENTS, prose
from pyspark.sql import functions as F

import corpus_pipeline
from bandloom.llm import neardups
from bandloom.llm.words import free_name

NAMES = ["_id", "_text", "_node", "cut", "Verdict", "verdict_", "row", "node", "id", "chosen", "least", "place", "spans", "one", "other", "mix", "z", "take", "time"]


def rows():
    passage = prose(2, 70)
    near = prose(5, 300).split(" ")
    near[40] = "changed"
    out = [(i, prose(20 + i, 150), "en", "abc"[i % 3], 1) for i in range(30)] + [(40, prose(5, 300), "en", "a", 1), (41, " ".join(near), "en", "a", 1)]
    out += [(50, prose(6, 90) + "\n" + passage, "en", "b", 1), (51, passage + " " + prose(7, 90), "en", "b", 1)]
    return out + [(60, "short", "en", "a", 1), (61, None, None, None, None), (None, prose(8, 120), "en", "c", 1), (70, prose(9, 120), "en", "c", 1)]


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    plain = spark.createDataFrame(rows(), DOCUMENTS).repartition(3, "doc_id")
    named = plain.withColumns({c: F.concat_ws("|", F.lit(c), F.col("doc_id").cast("string")) for c in NAMES})
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        a, b = stage(spark, plain, str(tmp_path)), stage(spark, named, str(tmp_path))
        assert a.columns == plain.columns and b.columns == named.columns, name
        for df, tag in ((a, "plain"), (b, "named")):
            df.write.parquet(f"{tmp_path}/{i}/{tag}")
        plain, named = (spark.read.parquet(f"{tmp_path}/{i}/{tag}") for tag in ("plain", "named"))
        key = lambda r: tuple((v is None, v) for v in r)
        got = named.collect()
        assert sorted(plain.collect(), key=key) == sorted((r[:5] for r in got), key=key), name
        assert got and all(r[c] == (c if r.doc_id is None else f"{c}|{r.doc_id}") for r in got for c in NAMES), name


def test_repeated_id_and_text_keep_the_same_row_every_time(spark):
    text = prose(3, 80)
    docs = spark.createDataFrame([(7, text, "en", s, n) for s, n in (("a", 1), ("b", 2), (None, None), ("c", 3))], DOCUMENTS)
    kept = {tuple(neardups.keep_first(docs.repartition(n, "source")).collect()[0]) for n in (1, 2, 4)}
    assert len(kept) == 1
    assert neardups.keep_first(docs.limit(0)).collect() == []


def test_free_name():
    assert free_name("cut", ["a"]) == "cut" and free_name("cut", ["CUT", "cut_"]) == "cut__"
