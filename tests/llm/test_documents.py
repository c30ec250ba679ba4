"""Document operators against brute force on awkward rows."""

import hashlib
import itertools
import math
import random
import re
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from cases import CLASHING, components, document_rows, documents, no_documents, prose, words
from tokenizers import Tokenizer

from bandloom.llm import mixing, packing, quality, rules, simhash, substrings

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def slow_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words(lowered)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(codes, bits=2):
    links = [(a, b) for a, b in itertools.combinations(sorted(set(codes)), 2) if bin(a ^ b).count("1") <= bits]
    return components(set(codes), links)


@pytest.mark.parametrize("clashing", [False, True])
def test_simhash_components(spark, clashing):
    got = simhash.simhash_components(documents(spark, clashing)).collect()
    rows = document_rows()
    group = slow_components([slow_fingerprint(r[1]) for r in rows])
    least = {}
    for doc, text, *_ in rows:
        if doc is not None:
            g = group[slow_fingerprint(text)]
            least[g] = min(least.get(g, doc), doc)
    expected = Counter((r[0], f"{slow_fingerprint(r[1]):016x}", least.get(group[slow_fingerprint(r[1])])) for r in rows)
    assert Counter(map(tuple, got)) == expected
    assert simhash.simhash_components(no_documents(spark)).collect() == []


def test_gray_index_finds_all_links_of_dense_and_sparse_codes(spark, monkeypatch):
    monkeypatch.setattr(simhash, "ROOT_CODES", 300)
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    codes = {rng.getrandbits(64) for _ in range(1500)}
    for _ in range(1200):
        codes.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    for code in rng.sample(sorted(codes), 300):
        codes.add(code ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))))
    ordered = sorted(codes)
    signed = [(c - (1 << 64) if c >> 63 else c, i) for i, c in enumerate(ordered)]
    found = simhash.fingerprint_links(spark.createDataFrame(signed, "code bigint, node bigint")).collect()
    array_ = np.array(ordered, dtype=np.uint64)
    links = [(i, int(j)) for i in range(len(ordered)) for j in i + 1 + np.flatnonzero(np.bitwise_count(array_[i + 1 :] ^ array_[i]) <= 2)]
    assert components(range(len(ordered)), [(r.a, r.b) for r in found]) == components(range(len(ordered)), links)
    assert len(found) < 20 * len(codes)


def slow_repeats(rows, window=20):
    seen, out = {}, {}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0])
    done = set()
    for doc, text, *_ in order:
        if doc in done:
            continue
        done.add(doc)
        w = words(text)
        cover = bytearray(len(w))
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                cover[i : i + window] = b"\1" * window
            else:
                seen[key] = 1
        kept = " ".join(x for x, c in zip(w, cover) if not c)
        out[doc] = (len(w), sum(cover), hashlib.sha256(kept.encode()).hexdigest(), kept)
    return out, seen


@pytest.mark.parametrize("clashing", [False, True])
def test_substring_removal(spark, clashing):
    docs = documents(spark, clashing)
    cut = substrings.remove_repeats(docs)
    assert cut.columns == [*docs.columns, "cut"]
    expected, seen = slow_repeats(document_rows())
    rows = cut.collect()
    assert len(rows) == len(document_rows())
    for r in rows:
        if r.doc_id is not None:
            assert tuple(r.cut) == expected[r.doc_id]
        else:
            # Rows without an id come last; one repeats a whole document, the other nothing.
            n = len(words(r.text))
            assert r.cut.n_words == n and r.cut.n_removed == (n if n == 300 else 0)
        if clashing:
            assert all(r[c] == f"mine {c}" for c in CLASHING)
    assert substrings.remove_repeats(no_documents(spark)).collect() == []


def test_substring_removal_with_shared_phrases(spark):
    rng = random.Random(8)
    phrases = [prose(i, rng.randint(5, 45), 50) for i in range(12)]
    rows = []
    for doc in range(120):
        parts = [rng.choice(phrases) if rng.random() < 0.6 else prose(1000 + doc * 9 + k, rng.randint(3, 30), 50) for k in range(8)]
        rows.append((doc, " ".join(parts), "en", "a", 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    expected, _ = slow_repeats(rows)
    got = {r.doc_id: tuple(r.cut) for r in substrings.remove_repeats(docs).collect()}
    assert got == expected
    spans = substrings.removal_spans(docs).filter("length > 20").collect()
    texts = {r[0]: words(r[1]) for r in rows}
    assert spans
    for s in spans:
        assert (s.source, s.source_start) < (s.place, s.start)
        assert texts[s.place][s.start : s.start + s.length] == texts[s.source][s.source_start : s.source_start + s.length]


def slow_rules(text):
    w = words(text)
    count = Counter(zip(w, w[1:], w[2:]))
    cover = bytearray(len(w))
    for i in range(len(w) - 2):
        if count[tuple(w[i : i + 3])] > 1:
            cover[i] = cover[i + 1] = cover[i + 2] = 1
    seen, lines = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            lines += line in seen
            seen.add(line)
    failed = len(w) < 50 or 100 * sum(cover) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, sum(cover), failed


@pytest.mark.parametrize("clashing", [False, True])
def test_quality_rules(spark, clashing):
    docs = documents(spark, clashing)
    judged = rules.judge_documents(docs)
    assert judged.columns == [*docs.columns, "verdict"]
    rows = judged.collect()
    assert len(rows) == len(document_rows())
    for r in rows:
        v = r.verdict
        assert (v.n_words, v.word_chars, v.n_symbols, v.n_dup_lines, v.n_repeat_words, v.base_failed) == slow_rules(r.text)
        assert not (v.kept and v.base_failed)
    assert rules.judge_documents(no_documents(spark)).collect() == []


def slow_distance(p, q):
    p, q = np.array(p) / sum(p), np.array(q) / sum(q)
    m = (p + q) / 2
    part = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m) if x)
    return math.sqrt(max((part(p) + part(q)) / 2, 0))


def test_divergence_from_the_language(spark):
    odd = " ".join(f"{x}###" for x in prose(99, 300).split(" "))
    rows = [(i, prose(i, 200), "en", "a", 1) for i in range(40)] + [(50, odd, "en", "a", 1), (51, odd[:100], "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = {r.doc_id: r.verdict for r in rules.judge_documents(docs).collect()}
    assert all(got[i].kept for i in range(40)) and not got[50].kept and not got[50].base_failed
    assert got[51].class_distance is None and got[51].word_distance is None

    def classes(text):
        left, counts = text, []
        for pattern in rules.CLASSES.values():
            shorter = re.sub(pattern, "", left)
            counts.append(len(left) - len(shorter))
            left = shorter
        return [*counts, len(left)]

    reference = np.sum([classes(r[1]) for r in rows], axis=0)
    bag = Counter(w.lower() for r in rows for w in words(r[1]))
    common = [w for w, _ in sorted(bag.items(), key=lambda x: (-x[1], x[0]))[: rules.COMMON_WORDS]]

    def bins(counter):
        found = [counter[w] for w in common]
        return [*found, sum(counter.values()) - sum(found)]

    for doc in (0, 7, 50):
        text = rows[doc if doc < 50 else 40][1]
        assert got[doc].class_distance == pytest.approx(slow_distance(classes(text), reference))
        assert got[doc].word_distance == pytest.approx(slow_distance(bins(Counter(w.lower() for w in words(text))), bins(bag)))


def slow_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left, opened = {}, float(sum(sizes.values())), set(names)
    while opened:
        total = sum(weight[s] for s in opened)
        over = {s for s in opened if left * weight[s] / total > cap * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in opened}
            break
        for s in over:
            target[s] = cap * sizes[s]
        left -= sum(target[s] for s in over)
        opened -= over
    return target


@pytest.mark.parametrize("clashing", [False, True])
def test_mixing(spark, clashing):
    docs = documents(spark, clashing)
    got = mixing.mix_sources(docs).collect()
    rows = document_rows()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    targets = slow_targets(sizes)
    source = defaultdict(list)
    for r in rows:
        source[(r[0], len(words(r[1])))].append(r[3])
    taken = Counter()
    assert len(got) == len(rows)
    for r in got:
        s = source[(r.doc_id, r.size)][0]
        assert r.source_size == sizes[s] and r.target == pytest.approx(targets[s])
        assert r.taken == sum(r.takes) <= 3 * r.size and len(r.takes) == 3
        times = [t for t in r.times if t is not None]
        assert len(times) == sum(t > 0 for t in r.takes) and times == sorted(times) and all(0 <= t <= 1 for t in times)
        taken[s] += r.taken
    assert all(abs(taken[s] - targets[s]) < 1 for s in sizes)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(documents(spark).repartition(7)).collect()))
    assert mixing.mix_sources(no_documents(spark)).collect() == []


def test_training_order_follows_the_curves(spark):
    rows = [(i, prose(i, 20 + i % 50), "en", "abc"[i % 3], 1) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    mixed = mixing.mix_sources(docs)
    ordered = mixing.training_order(docs, mixed)
    assert ordered.columns == docs.columns
    out = ordered.collect()
    assert sum(len(words(r.text)) for r in out) == sum(r.taken for r in mixed.collect())
    half = [Counter(), Counter()]
    for i, r in enumerate(out):
        half[i >= len(out) // 2][r.source] += len(words(r.text))
    assert half[0]["a"] > half[1]["a"] and half[0]["c"] < half[1]["c"]
    for curve in [*mixing.CURVES, ((0, 0), (0.3, 2), (0.5, 0), (1, 1))]:
        shares = spark.range(101).selectExpr("id / 100 as share")
        times = [r[0] for r in shares.select(mixing.time_of(shares["share"], curve)).collect()]
        for share, time in zip(np.arange(101) / 100, times):
            reached = 0
            for start, length, rate, end, before in mixing.demand_steps(curve):
                x = min(max(time - start, 0), length)
                reached += rate * x + (end - rate) / length * x * x / 2
            assert reached == pytest.approx(share, abs=1e-9)


def ids_of(text, tokenizer=Tokenizer.from_file(TOKENIZER)):
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


@pytest.mark.parametrize("clashing", [False, True])
def test_packing(spark, clashing):
    rows = document_rows()
    got = packing.pack_documents(documents(spark, clashing), TOKENIZER, keep_ids=True).collect()
    expected = Counter()
    for doc, text, *_ in rows:
        ids = ids_of(text)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            cut = ids[start : start + 4096]
            expected[(doc, piece, start, len(cut), zlib.crc32(array("I", cut).tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == expected
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len(by) == -(-sum(r.length for r in got) // 4096)
    assert packing.pack_documents(no_documents(spark), TOKENIZER).collect() == []


def test_tokens_of_odd_texts():
    texts = ["", " ", "don 't <|endoftext|> x", "á e ́", "ΣΑΣ Σ", "x y z\x1cq", "\n\n a\r\nb\tc", "😀👍🏽 ﬁ ㎏", "1234 5,6.7", "I'm it's we'll"]
    for text, got in zip(texts, packing.token_bytes(texts, TOKENIZER)):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(text)[:-1]


def fewest(lengths, limit):
    """Fewest bins by trying every placement of small lists."""
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for b in sorted(set(bins)):
            if b + lengths[i] <= limit:
                k = bins.index(b)
                place(i + 1, [*bins[:k], b + lengths[i], *bins[k + 1 :]])
        place(i + 1, [*bins, lengths[i]])

    lengths = sorted(lengths, reverse=True)
    place(0, [])
    return best


def test_bin_completion_beats_or_equals_best_fit():
    rng = random.Random(5)
    worse = 0
    for _ in range(60):
        lengths = [rng.randint(5, 60) for _ in range(9)]
        plan, bins = packing.packing_plan(Counter(lengths), 100)
        worse += bins - fewest(lengths, 100)
        assert plan[:, 2].min() >= 1
    assert worse <= 3
    assert packing.packing_plan({}, 100)[1] == 0
    assert packing.packing_plan({2096: 1000, 300: 2000, 280: 5000}, 4096)[1] == 1000
    exact = packing.complete_bin(10, [3, 4, 7], {3: 2, 4: 1, 7: 1})
    assert sum(k * n for k, n in exact) == 10


def test_quality_scores(spark):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.7
        text = prose(i, rng.randint(20, 120))
        rows.append((i, text if good else " ".join(f"{w}###" for w in text.split(" ")), "en", "a", len(text)))
        labels.append((i, int(good)))
    docs = spark.createDataFrame([*rows, *[r for r in document_rows() if r[0] is None or r[0] in (16, 17, 18, 24)]], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    marked = spark.createDataFrame([*labels, (16, None), (None, 1)], "doc_id bigint, quality int")
    model = quality.fit_quality(docs, marked.filter(~quality.held_out()), metadata_cols=("n_chars",))
    out = quality.score_quality(docs, model, metadata_cols=("n_chars",)).select("*", quality.held_out().alias("held_out")).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    truth = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert np.mean([r.predicted == truth[r.doc_id] for r in held if r.doc_id > 30]) > 0.95
    flat = quality.fit_quality(docs, marked.filter("quality > 5"))
    assert {r.score for r in quality.score_quality(docs, flat).collect()} == {0.5}
    assert quality.score_quality(no_documents(spark), model, metadata_cols=("n_chars",)).collect() == []


def test_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.RandomState(0)
    model = quality.FactorModel(0.3, rng.normal(size=50), rng.normal(size=(50, 4)), 50)
    places, values = rng.choice(50, 7, replace=False), rng.normal(size=7)
    pairs = sum(model.factors[a] @ model.factors[b] * x * y for (a, x), (b, y) in itertools.combinations(zip(places, values), 2))
    expected = 0.3 + model.linear[places] @ values + pairs
    assert model.margin(places, values, np.array([0, 7]))[0] == pytest.approx(expected)


@pytest.mark.parametrize("nodes", [0, 3, 400])
def test_fillings_are_the_fullest(nodes):
    rng = random.Random(nodes)
    for _ in range(150):
        counts = {rng.randrange(1, 60): rng.randrange(1, 5) for _ in range(rng.randrange(1, 7))}
        room = rng.randrange(0, 120)
        sums = {0}
        for length, n in counts.items():
            sums = {s + k * length for s in sums for k in range(n + 1) if s + k * length <= room}
        filling = packing.complete_bin(room, sorted(counts), counts, nodes)
        assert all(0 < n <= counts[length] for length, n in filling)
        assert sum(length * n for length, n in filling) == max(sums)


def test_forgotten_words_are_learned_again(monkeypatch):
    monkeypatch.setattr(packing, "_CACHED_WORDS", 12)
    texts = ["Alpha beta, gamma.", "delta Épsilon! don't stop...", "ALPHA zeta eta theta iota kappa", "İx beta. ǅ naïve, ß. a.b c,d e.", "", "x" * 50 + ".,"] * 3
    coder = packing._Coder(TOKENIZER)
    direct = coder.ids(texts)
    for at in range(0, len(texts), 2):
        assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts[at : at + 2])] == [x.tolist() for x in direct[at : at + 2]]
