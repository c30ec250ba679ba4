"""Fill-in-middle against a direct cut of the lines, and the boundary set against plain indexing."""

import hashlib
import re

import numpy as np
import pytest
from cases import documents, no_documents
from pyspark.sql import functions as F

from bandloom.llm import infill

LINE = re.compile(r"[^\n]*\n|[^\n]+")


def brute(doc_id, text, percent=100, spm=50, unit=LINE):
    text = text or ""
    units = unit.findall(text)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("values", [
    [], [0], [65_535, 65_536, 200_000], range(0, 400_000, 7), range(10, 70_000), range(0, 140_000, 2), [3, 4, 5, 9, *range(65_530, 66_000)],
])
def test_boundary_set(values):
    values = np.array(values, dtype=np.int64)
    held = infill.BoundarySet(values)
    assert held.size == len(values)
    if len(values):
        k = np.unique(np.concatenate((np.arange(min(300, len(values))), np.linspace(0, len(values) - 1, 300).astype(int))))
        assert held.select(k[::-1]).tolist() == values[k[::-1]].tolist()


def test_container_kinds():
    assert isinstance(infill.container(np.array([1, 9, 70])), infill.ArrayContainer)
    assert isinstance(infill.container(np.arange(0, 65_536, 2)), infill.BitmapContainer)
    assert isinstance(infill.container(np.arange(5, 60_000)), infill.RunContainer)


def test_documents(spark):
    more = [(40 + i, f"a\n\n{'é😀' * i}\nlast {i}", "en", "a", 1) for i in range(40)] + [
        (90, "x <S> y\n", "en", "a", 1), (91, "\n" * 50, "en", "a", 1), (92, "<P", "en", "a", 1), (93, "a<\nS>\n<\nM>", "en", "a", 1), (94, "r\rs\r\nt" * 30_000, "en", "a", 1),
    ]
    docs = documents(spark, clashing=True)
    extra = spark.createDataFrame(more, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.unionByName(extra, allowMissingColumns=True).withColumn("infill", F.lit(1)).withColumn("text2", F.col("text"))
    out = infill.fill_in_middle(docs)
    assert out.columns == [c for c in docs.columns if c != "infill"] + ["infill"]
    forms = set()
    rows = out.withColumn("back", infill.restore_text(F.col("infill.output"), F.col("infill.form"))).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert tuple(r["infill"]) == brute(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
        forms.add(r["infill"]["form"])
    assert forms == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(no_documents(spark)).count() == 0


def test_rates_and_units(spark):
    docs = spark.createDataFrame([(i, f"line {i}\nnext\n") for i in range(200)], "doc_id bigint, text string")
    none = infill.fill_in_middle(docs, percent=0).select("infill.form").distinct().collect()
    assert [r.form for r in none] == ["plain"]
    half = infill.fill_in_middle(docs, percent=40, spm_percent=0).collect()
    assert {r["infill"]["form"] for r in half} == {"plain", "psm"}
    assert all(tuple(r["infill"]) == brute(r["doc_id"], r["text"], 40, 0) for r in half)
    chars = infill.fill_in_middle(docs, unit="char").collect()
    assert all(tuple(r["infill"]) == brute(r["doc_id"], r["text"], unit=re.compile("(?s).")) for r in chars)
