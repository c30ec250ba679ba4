"""Near duplicates of the pipeline against brute-force Jaccard similarity."""

import itertools
import random

import numpy as np
from cases import DOCUMENTS, components, no_documents, prose, words
from pyspark.sql import functions as F

import corpus_pipeline
from bandloom.llm import neardups, simhash


def slow_grams(text):
    held = [w.lower() for w in words(text)]
    return {tuple(held[i : i + 5]) for i in range(max(1, len(held) - 4))} if held else set()


def slow_kept(rows, limit=0.8):
    """Rows (id, text) that stay: of each group the smallest id."""
    sets = [slow_grams(r[1]) for r in rows]
    links = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2)
             if sets[i] == sets[j] or (sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= limit)]
    group, best = components(range(len(rows)), links), {}
    for i in range(len(rows)):
        if rows[i][0] is not None and (group[i] not in best or rows[i][0] < best[group[i]]):
            best[group[i]] = rows[i][0]
    return sorted(best.values()), sum(g not in best for g in set(group.values()))


def edited(text, rng, changes):
    held = text.split(" ")
    for at in rng.sample(range(len(held)), changes):
        held[at] = rng.choice([f"new{rng.randint(0, 999)}", ""])
    return " ".join(held)


def as_docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], DOCUMENTS).repartition(4)


def test_edited_copies_go_as_brute_force_says(spark):
    rng = random.Random(5)
    rows = []
    for base in range(60):
        text = prose(base + 900, rng.choice([60, 150, 400]))
        rows.append((len(rows), text))
        rows += [(len(rows) + k, edited(text, rng, rng.randint(1, max(1, len(text.split()) // 30)))) for k in range(4)]
    rows += [(9001, rows[0][1].upper()), (9002, None), (9003, " \n"), (9004, "one two"), (9005, "ONE  two"), (9006, "one")]
    kept, unnamed = slow_kept(rows)
    got = corpus_pipeline.simhash_dedup(spark, as_docs(spark, rows), "").collect()
    assert sorted(r.doc_id for r in got) == kept and unnamed == 0
    assert 60 < len(kept) < 250
    assert corpus_pipeline.simhash_dedup(spark, no_documents(spark), "").collect() == []


def test_copies_linked_through_a_hub_only(spark):
    # Copies changed at different places are near the base alone; the buckets span several blocks.
    rows = []
    for start, base in ((1000, prose(77, 70)), (2000, prose(78, 70))):
        rows += [(start + i, " ".join(f"x{i}" if k == (10, 25, 40, 55)[i % 4] else w for k, w in enumerate(base.split(" ")))) for i in range(150)]
    rows.append((5000, prose(77, 70)))
    kept, _ = slow_kept(rows)
    assert kept == [1000, 2000, 2001, 2002, 2003]
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, as_docs(spark, rows), "").collect()) == kept


def test_documents_without_id_stay_once_per_group(spark):
    rng = random.Random(2)
    one, two = prose(81, 200), prose(82, 200)
    rows = [(None, one), (None, edited(one, rng, 1)), (None, edited(one, rng, 2)), (None, two), (7, edited(two, rng, 1)), (3, prose(83, 200)), (3, prose(84, 200))]
    got = corpus_pipeline.simhash_dedup(spark, as_docs(spark, rows), "").collect()
    assert sorted(str(r.doc_id) for r in got) == ["3", "3", "7", "None"]
    assert sum(r.doc_id is None and r.text in [t for i, t in rows[:3]] for r in got) == 1


def test_close_simhashes_are_found_and_verified(spark, monkeypatch):
    # Without any band only SimHash can bring texts together.
    sketch = neardups._sketch
    monkeypatch.setattr(neardups, "_sketch", lambda text: sketch(text).withField("bands", F.array().cast("array<bigint>")))
    long = prose(85, 1500, 4000).split(" ")
    near = " ".join([*long[:700], "new", *long[701:]])
    filler = "same " * 80
    rows = [(5, " ".join(long)), (6, near), (7, prose(86, 1500, 4000)), (8, filler + prose(87, 30)), (9, filler + prose(88, 30))]
    code = {i: simhash.text_fingerprint(t, neardups.SHINGLE) for i, t in rows}
    assert all(neardups.simhash(neardups.shingle_hashes(t)) % (1 << 64) == code[i] for i, t in rows)
    # The last two have one SimHash but share hardly a shingle.
    assert 0 < (code[5] ^ code[6]).bit_count() <= 2 and code[8] == code[9]
    assert slow_kept(rows) == ([5, 7, 8, 9], 0)
    got = corpus_pipeline.simhash_dedup(spark, as_docs(spark, rows), "").collect()
    assert sorted(r.doc_id for r in got) == [5, 7, 8, 9]


def copies_in_groups(rng):
    """Copies of two texts, changed at one to eight of 12 places, so that buckets hold one large and many small groups."""
    rows = []
    for start, base in ((1000, prose(91, 120)), (2000, prose(92, 120))):
        for i in range(220):
            held = base.split(" ")
            for at in rng.sample(range(4, 120, 10), rng.randint(1, 8)):
                held[at] = f"x{rng.randint(0, 3)}"
            rows.append((start + i, " ".join(held)))
    return rows


def test_rows_compared_do_not_grow_with_the_square_of_a_bucket(spark, monkeypatch):
    written, cut = {}, neardups.cut_lineage
    monkeypatch.setattr(neardups, "cut_lineage", lambda df, name="stage": written.setdefault(name, cut(df, name)))
    rows = copies_in_groups(random.Random(3))
    kept, _ = slow_kept(rows)
    got = corpus_pipeline.simhash_dedup(spark, as_docs(spark, rows), "").collect()
    assert sorted(r.doc_id for r in got) == kept and 20 < len(kept) < 400
    mixed = written["blocks"].groupBy("key").count()
    members = written["members"].join(mixed, "key")
    assert mixed.agg(F.max("count")).first()[0] > 130
    assert written["blocks"].count() == members.count()


def test_many_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardups, "BLOCK_TEXTS", 16)
    rows = copies_in_groups(random.Random(4))
    kept, _ = slow_kept(rows)
    got = corpus_pipeline.simhash_dedup(spark, as_docs(spark, rows), "").collect()
    assert sorted(r.doc_id for r in got) == kept


def test_shared_hashes_are_counted_in_chunks(monkeypatch):
    monkeypatch.setattr(neardups, "_CELLS", 40)
    rng = np.random.RandomState(1)
    sets = [np.unique(rng.randint(0, 60, size=n).astype(np.uint64)) for n in (5, 30, 1, 0, 50, 17)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    # Hashes of one set alone are in no pair, so the diagonal is not asked for.
    off = ~np.eye(len(sets), dtype=bool)
    assert (neardups.common_counts(sets)[off] == np.array(want)[off]).all()
    assert (neardups.common_counts(sets[:2], sets[2:]) == np.array(want)[:2, 2:]).all()
    assert (neardups.common_counts([sets[0][:0]], [sets[0][:0]]) == 0).all()
