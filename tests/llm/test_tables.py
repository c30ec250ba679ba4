"""Vectors, archives, licences and conversations against brute force; queries against SQL; the pipeline."""

import base64
import gzip
import hashlib
import itertools
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from cases import CLASHING, components, document_rows, documents, no_documents, prose, words
from pyspark.sql import functions as F

import __spark_entry__ as contract
import check
import corpus_pipeline
from bandloom.llm import chat, embeddings, licenses, sql, warc
from bandloom.llm.components import components as spark_components
from bandloom.session import scratch_path

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id bigint, embedding array<float>, label int"


def slow_links(rows, cosine=0.98):
    usable = [(i, np.array(v, float), l) for i, v, l in rows if v and l is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return [
        (a, b) for (a, x, k), (b, y, m) in itertools.combinations(usable, 2)
        if k == m and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= cosine
    ]


def vector_rows(seed=0, clusters=25, size=8, dim=64):
    rng = np.random.RandomState(seed)
    rows = []
    for c in range(clusters):
        centre = rng.normal(size=dim)
        for _ in range(size):
            rows.append((len(rows), [float(np.float32(v)) for v in centre + rng.normal(scale=rng.choice([0.0, 0.05, 0.12, 0.2]), size=dim)], c % 3))
    return rows


def test_vector_recall_and_exactness(spark):
    rows = vector_rows(clusters=60)
    one = rows[3][1]
    rows += [(9000, None, 1), (9001, [0.0] * 64, 1), (9002, [float("nan")] + [1.0] * 63, 1), (9003, [float("inf")] + [1.0] * 63, 1), (9004, [None] + [1.0] * 63, 1),
             (9005, one, None), (9006, one, rows[3][2]), (9007, one[:5], rows[3][2]), (9008, one[:5], rows[3][2]), (9009, [], 1), (9010, [x * 1e-30 for x in one], rows[3][2])]
    df = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(c) for c in CLASHING})
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    assert len(got) == len(rows)
    links = slow_links(rows)
    degree = Counter(x for pair in links for x in pair)
    assert all(r.n_links <= degree[i] for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * 2 * len(links)
    least = components([r[0] for r in rows], links)
    assert np.mean([got[i].component_id == least[i] for i in got]) > 0.98
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    for i in (9000, 9001, 9002, 9003, 9004, 9005, 9009):
        assert tuple(got[i]) == (i, 0, i, True)
    assert got[9007].n_links == got[9008].n_links == 1 and got[9008].component_id == 9007


def test_vectors_with_repeats_and_without_ids(spark):
    v = [1.0, 2.0, 3.0, 4.0]
    df = spark.createDataFrame([(5, v, 1), (5, v, 1), (None, v, 1), (None, [4.0, -3.0, 1.0, 0.0], 1), (2, [4.0, 3.0, 0.0, 0.0], 1)], VECTORS)
    got = sorted(map(tuple, embeddings.near_vectors(df).collect()), key=str)
    assert got == sorted([(5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (None, 0, None, False), (2, 0, 2, True)], key=str)
    assert embeddings.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


def test_large_buckets_are_compared_in_blocks(spark):
    rng = np.random.RandomState(1)
    centre = rng.normal(size=16)
    rows = [(i, [float(x) for x in centre + rng.normal(scale=0.05, size=16)], 1) for i in range(150)]
    nodes = spark.createDataFrame([(i, l, v, 1) for i, v, l in rows], "node bigint, label int, vector array<double>, n bigint")
    found = embeddings.vector_links(nodes, block=20).groupBy("a").agg(F.sum("links").alias("links")).collect()
    degree = Counter(x for pair in slow_links(rows) for x in pair)
    assert {r.a: r.links for r in found} == dict(degree)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in spark_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    nodes = {n for pair in links for n in pair}
    assert got == components(nodes, links)
    assert spark_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


PAGES = "page_id bigint, url string, html string"
PAGE_ROWS = [
    (3, "http://a/x", "same"), (1, "http://a/y", "same"), (2, None, "same"), (4, "http://b/\r\nevil: 1", None), (5, "u", ""), (6, "u", "WARC/1.1\r\n\r\n\r\n\r\nWARC/1.1\r\n"),
    (7, "é", "é😀\r\n\r\n" * 3), (8, "u", "x" * 300_000), (None, "u", "only without id"), (9, "u", "\n"), (10, "u", "same"),
]


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_come_back(spark, compression):
    pages = spark.createDataFrame(PAGE_ROWS, PAGES).withColumns({c: F.lit(c) for c in CLASHING})
    path = scratch_path(spark, "archive")
    warc.write_archive(pages, path, compression=compression, pages_per_file=4)
    records = warc.read_archive(spark, path)
    assert Counter(r.type for r in records.collect()) == {"request": 11, "metadata": 11, "response": 7, "revisit": 4}
    captures = warc.assemble_captures(records)
    rows = captures.collect()
    assert len(rows) == len(PAGE_ROWS) and all(len(r.requests) == 1 and len(r.metadata) == 1 for r in rows)
    first = {}
    for page, _, html in sorted(PAGE_ROWS, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(html or "", page)
    got = {r.page_id: r for r in warc.page_captures(captures).collect()}
    assert len(got) == len(PAGE_ROWS)
    for page, _, html in PAGE_ROWS:
        payload, r = (html or "").encode(), got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[html or ""] == page else ("revisit", first[html or ""]))
    texts = {r.response.record_id.split("-")[0]: bytes(r.response.payload).decode() for r in rows if r.response.type == "response"}
    assert texts["<urn:capture:response:8"] == "x" * 300_000 and texts["<urn:capture:response:7"] == PAGE_ROWS[6][2]


def test_pages_without_or_with_repeated_ids_are_all_captured(spark):
    rows = [(None, "u", "a"), (None, "u", "a"), (None, "v", "b"), (7, "u", "b"), (7, "u", "b"), (7, "u", "c"), (8, "u", "c"), (9, None, None), (None, None, "")]
    pages = spark.createDataFrame(rows, PAGES).repartition(3)
    path = scratch_path(spark, "pages")
    pages.write.parquet(path)
    pages = spark.read.parquet(path)
    archive = scratch_path(spark, "archive")
    warc.write_archive(pages, archive)
    records = warc.read_archive(spark, archive)
    assert records.select("record_id").distinct().count() == 3 * len(rows)
    got = warc.page_captures(warc.assemble_captures(records))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{path}/*.parquet'")
    names = "page_id, payload_bytes, payload_digest, record_type, refers_to"
    expected = con.execute(f"select {names} from ({sql.OP5})").fetchall()
    assert sorted((tuple(r) for r in got.select(*names.split(", ")).collect()), key=str) == sorted(expected, key=str)


def test_small_payloads_are_never_revisits(spark):
    path = scratch_path(spark, "archive")
    warc.write_archive(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], PAGES), path, min_revisit_bytes=3)
    got = warc.page_captures(warc.assemble_captures(warc.read_archive(spark, path))).collect()
    assert sorted((r.page_id, r.record_type) for r in got) == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]
    empty = scratch_path(spark, "archive")
    warc.write_archive(spark.createDataFrame([], PAGES), empty)
    assert warc.page_captures(warc.assemble_captures(warc.read_archive(spark, empty))).collect() == []


def test_captures_through_chains_and_strays(spark):
    rows = [
        ("f", 0, "response", "<r1>", ["<q1>"]), ("f", 1, "request", "<q1>", []), ("f", 2, "metadata", "<m1>", ["<q1>"]),
        ("f", 3, "revisit", "<r2>", []), ("f", 4, "request", "<q2>", ["<r2>"]), ("f", 5, "metadata", "<m2>", ["<q2>"]), ("f", 6, "metadata", "<alone>", ["<gone>"]), ("f", 7, "warcinfo", "<i>", []),
    ]
    records = spark.createDataFrame(rows, "file string, at bigint, type string, record_id string, concurrent_to array<string>")
    got = {r.capture_id: ([x.record_id for x in r.requests], [x.record_id for x in r.metadata]) for r in warc.assemble_captures(records).collect()}
    assert got == {"<r1>": (["<q1>"], ["<m1>"]), "<r2>": (["<q2>"], ["<m2>"]), "<alone>": ([], ["<alone>"]), "<i>": ([], ["<i>"])}


def test_broken_archives_fail():
    good = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [(at, block) for at, _, block in warc.split_records(good + good)] == [(0, b"abc"), (len(good), b"abc")]
    assert [b for _, _, b in warc.split_records(gzip.compress(good) + gzip.compress(good))] == [b"abc", b"abc"]
    for bad in (good[:-2], good.replace(b"3", b"2"), b"junk" + good):
        with pytest.raises(ValueError):
            list(warc.split_records(bad))


def test_licences(spark):
    lines = {
        "mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.",
        "cc-by-nc": "Licensed under CC BY-NC 4.0.", "apache": "Licensed under the Apache License, Version 2.0.",
    }
    rows = [(100 + i, prose(i, 60) + "\n" + prose(i + 500, 30), "en", "a", 1) for i in range(80)]
    rows += [(i, f"{prose(i, 40)}\n{line}\n{prose(i, 9)}", "en", "a", 1) for i, line in enumerate(lines.values())]
    rows += [(10, "\n".join(lines.values()), "en", "a", 1), (11, "You need a driving license to rent a car in the public library.", "en", "a", 1), (12, "MIT", "en", "a", 1)]
    docs = spark.createDataFrame([*rows, *document_rows()], "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit(c) for c in CLASHING})
    model = licenses.fit_licences(docs)
    out = licenses.document_licences(docs, model).collect()
    assert len(out) == docs.count()
    families = {r.doc_id: r.families for r in out if r.doc_id is not None and r.doc_id < 10 and r.doc_id >= 0}
    assert families == {i: [name] for i, name in enumerate(lines)}
    assert [(r.n_paragraphs, r.n_notices) for r in out if r.families == sorted(lines)] == [(1, 4)]
    assert sum(len(r.families) > 0 for r in out) == 5
    # Every held variant of every notice of some length is told from the rest.
    notices = licenses._notices(spark).selectExpr("family", "line as text").withColumn("doc_id", F.monotonically_increasing_id())
    found = licenses.scan_licences(notices, model).join(notices.select(F.col("doc_id").alias("doc"), F.col("family").alias("true")), "doc").collect()
    assert len({r.doc for r in found}) >= 0.9 * notices.count() and np.mean([r.family == r.true for r in found]) > 0.95
    assert licenses.document_licences(no_documents(spark), model).collect() == []


TURNS = "conv_id bigint, turn bigint, role string, text string"


def slow_pair(chosen, rejected):
    render = lambda turns: "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in turns)
    n = 0
    while n < min(len(chosen), len(rejected)) and chosen[n] == rejected[n]:
        n += 1

    def spans(turns):
        at, out = 0, []
        for r, t in turns:
            head, body = f"<|{r}|>\n", f"{t}<|end|>\n"
            if r == "assistant":
                out.append((at + len(head), len(body)))
            at += len(head) + len(body)
        return out

    return n, render(chosen[:n]), render(chosen[n:]), render(rejected[n:]), spans(chosen[n:]), spans(rejected[n:])


def test_preferences(spark):
    talks = {
        0: [("user", "hi"), ("assistant", "a"), ("user", "b"), ("assistant", "é😀")], 1: [("user", "hi"), ("assistant", "a"), ("assistant", "c")],
        2: [("user", "x")], 3: [("user", "x")], 4: [("user", "q"), ("assistant", "r")], 5: [("user", "q")], 6: [("assistant", "solo")], 9: [("assistant", "other")],
        10: [("", ""), ("user", "")], 11: [("", ""), ("user", "y")], -2: [("user", "n")], -1: [("user", "m")],
    }
    rows = [(c, 3 * i, r or None, t or None) for c, turns in talks.items() for i, (r, t) in enumerate(turns)]
    rows += [(20, 1, "user", "same turn"), (20, 1, "assistant", "tie"), (20, None, "system", "first"), (21, 0, "system", "first"), (None, 0, "user", "nobody")]
    talks[20], talks[21] = [("system", "first"), ("assistant", "tie"), ("user", "same turn")], [("system", "first")]
    turns = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit(c) for c in CLASHING})
    pairs = chat.neighbour_pairs(turns)
    got = {r.pair_id: r for r in chat.format_preferences(turns, pairs).collect()}
    assert sorted(got) == [-1, 0, 1, 2, 3, 4, 5, 10]
    for k, r in got.items():
        if 2 * k in talks and 2 * k + 1 in talks:
            n, prompt, chosen, rejected, mask, other = slow_pair(talks[2 * k], talks[2 * k + 1])
            assert (r.prefix_turns, r.prompt, r.chosen, r.rejected) == (n, prompt, chosen, rejected)
            assert [tuple(s) for s in r.chosen_mask] == mask and [tuple(s) for s in r.rejected_mask] == other
            assert r.status == ("equal" if k == 1 else "pair")
    assert (got[3].status, got[3].rejected, got[3].prompt) == ("no_rejected", None, "") and got[4].status == "no_chosen"
    assert chat.format_preferences(spark.createDataFrame([], TURNS), pairs.limit(0)).collect() == []
    assert chat.neighbour_pairs(spark.createDataFrame([], TURNS)).collect() == []


NUMBERED = sorted(n for n in contract.queries() if n.startswith("op") and n[2].isdigit())


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in NUMBERED) == list(range(1, 14)) and "pipeline" in contract.queries()


@pytest.mark.parametrize("name", [n for n in NUMBERED if n in contract.oracle_sql()])
def test_numbered_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in check.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = contract.queries()[name](spark, SF)
    cur = con.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert check.fingerprint(df.columns, [tuple(r) for r in df.collect()]) == check.fingerprint(columns, cur.fetchall())


def test_pipeline_stages(spark, tmp_path):
    path = str(tmp_path)
    extra = [(500 + i, prose(40 + i, 150), "en", "abc"[i % 3], 1) for i in range(40)] + [(600, prose(40, 150), "en", "a", 1)]
    extra += [(700, prose(90, 150), "en", "a", 1)] * 2
    source = spark.createDataFrame([*document_rows(), *extra], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    source.write.parquet(f"{path}/documents.parquet")
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kinds, seen = docs.dtypes, {}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_dedup", "substring_dedup", "curriculum_mix", "bin_completion_pack"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if i < 4:
            assert out.dtypes == kinds
        out.write.parquet(f"{path}/{i}")
        docs = spark.read.parquet(f"{path}/{i}")
        seen[name] = docs.collect()
    ids = lambda name: [r.doc_id for r in seen[name]]
    # Clean documents stay, blank, short and repetitive ones go.
    assert set(range(500, 540)) <= set(ids("quality_rules")) and not {16, 17, 18, 19, 23, 24} & set(ids("quality_rules"))
    # Of exact copies, of a text with one word changed and of a repeated row one stays.
    assert {10, *range(500, 540)} <= set(ids("simhash_dedup")) and not {11, 12, 600} & set(ids("simhash_dedup")) and ids("simhash_dedup").count(700) == 1
    left = {r.doc_id: r for r in seen["substring_dedup"]}
    assert all(len(r.text) == r.n_chars for r in left.values())
    grams = Counter(tuple(words(r.text)[i : i + 20]) for r in left.values() for i in range(len(words(r.text)) - 19) if (r.doc_id or 0) >= 500)
    assert max(grams.values()) == 1
    tokens = defaultdict(int)
    for r in seen["bin_completion_pack"]:
        tokens[r.sequence_id] += r.length
    assert len(tokens) == -(-sum(tokens.values()) // 4096)
    direct = corpus_pipeline.run(spark, path).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.piece, r.ids_crc32)
    assert [key(r) for r in sorted(direct, key=key)] == [key(r) for r in sorted(seen["bin_completion_pack"], key=key)]
    no_documents(spark).write.parquet(f"{path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{path}/none").collect() == []
    assert documents(spark).count() == len(document_rows())
