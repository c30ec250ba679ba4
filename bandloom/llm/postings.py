"""Benchmark passages in training texts through a distributed positional inverted index.

Tasks turn documents into blocks of bounded size. A block numbers the words of its
documents with a gap between them and keeps the rising positions of every word of the
test set. The index is a table of such blocks, so no list of a frequent word is ever
in one place. Word counts over all blocks order the words of each test window from
the rarest; its positions, moved back by its place in the window, are the candidate
starts, and every further list takes away those it does not hold. With a slop, words
may stand that far from their place.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.functions.sizing import lookup_join
from bandloom.session import cut_lineage

WINDOW = 10
# Words of a block; a longer document is a block of its own.
BLOCK_WORDS = 1 << 19
# Test windows that are searched together and sent to every task.
CHUNK_WINDOWS = 100_000
# Distinct test words up to which the index keeps only these; beyond, it keeps all words.
VOCABULARY = 1_000_000
_CANDIDATES = 2_000_000
_PLACE = 32

# A-Z become a-z; digits, a-z and everything beyond ASCII stay; all else separates words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_INDEX = "block bigint, doc_ids array<bigint>, sizes array<int>, terms array<string>, counts array<int>, postings binary"
_FOUND = "block bigint, doc int, starts array<int>, lengths array<int>, windows array<bigint>, near array<bigint>"


def folded_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class _Numbers(dict):
    """Words numbered in order of arrival."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


class _Known(dict):
    """Fixed numbers of known words; -1 for all others."""

    def __missing__(self, word: bytes) -> int:
        return -1


def _block_row(block: int, ids: list, split: list[list[bytes]], known: _Known | None, names: list[str] | None, gap: int) -> tuple:
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    spaced = sizes + gap
    total = int(sizes.sum())
    numbers = _Numbers() if known is None else known
    terms = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), dtype=np.int32, count=total)
    places = np.arange(total) + np.repeat(np.cumsum(spaced) - spaced - np.cumsum(sizes) + sizes, sizes)
    if known is None:
        words = list(numbers)
        order = sorted(range(len(words)), key=words.__getitem__)
        by_name = np.empty(len(words), dtype=np.int32)
        by_name[order] = np.arange(len(words), dtype=np.int32)
        terms, names = by_name[terms] if total else terms, [words[i].decode("utf-8", "surrogatepass") for i in order]
    else:
        met = terms >= 0
        terms, places = terms[met], places[met]
    order = np.argsort(terms, kind="stable")
    present, counts = np.unique(terms, return_counts=True)
    return block, ids, sizes.astype(np.int32), [names[i] for i in present.tolist()], counts.astype(np.int32), places[order].astype("<u4").tobytes()


def _index_rows(shared, gap: int, block_words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = shared.value if shared is not None else None
        known = None if names is None else _Known((name.encode("utf-8", "surrogatepass"), i) for i, name in enumerate(names))
        block = TaskContext.get().partitionId() << 32
        columns = [part.split()[0] for part in _INDEX.split(", ")]
        ids, split, size = [], [], 0

        def flush():
            return pd.DataFrame([_block_row(block, ids, split, known, names, gap)], columns=columns)

        for batch in batches:
            for doc, text in zip(batch["id"].astype(object).where(batch["id"].notna(), None), batch["text"]):
                words = folded_words(text)
                if split and size + len(words) > block_words:
                    yield flush()
                    block, ids, split, size = block + 1, [], [], 0
                ids.append(doc)
                split.append(words)
                size += len(words) + gap
        if split:
            yield flush()

    return run


def build_index(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: list[str] | None = None, gap: int = WINDOW, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """One row per block: its documents with their sizes, and per word the rising positions.

    Documents of a block are laid out with `gap` free positions between them. `words`
    (in byte order, of checked size) bounds the words that are kept. The table is
    written to the shared folder and can serve several searches.
    """
    shared = None if words is None else docs.sparkSession.sparkContext.broadcast(words)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return cut_lineage(texts.mapInPandas(_index_rows(shared, gap, block_words), _INDEX), "postings")


def _item_windows(window: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text in zip(batch["item"], batch["text"]):
                words = [w.decode("utf-8", "surrogatepass") for w in folded_words(text)]
                rows += [(item, " ".join(words[i : i + window])) for i in range(max(len(words) - window, 0) + 1) if words]
            yield pd.DataFrame(rows, columns=["item", "phrase"])

    return run


def test_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Tables (window_id, phrase) of the distinct windows and (window_id, item) of the items that hold them."""
    texts = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    pairs = cut_lineage(texts.mapInPandas(_item_windows(window), "item string, phrase string").distinct(), "item_windows")
    phrases = cut_lineage(pairs.select("phrase").distinct().withColumn("window_id", F.monotonically_increasing_id()), "windows")
    return phrases, pairs.join(phrases, "phrase").select("window_id", "item")


class _Queries:
    """Windows as word numbers and places, the rarest word first; -1 fills short windows."""

    def __init__(self, ids: np.ndarray, phrases: list[str], frequency: dict[str, int]):
        split = [p.split(" ") for p in phrases]
        found = [i for i, words in enumerate(split) if all(w in frequency for w in words)]
        self.names = sorted({w for i in found for w in split[i]}, key=lambda w: w.encode("utf-8", "surrogatepass"))
        number = {w: i for i, w in enumerate(self.names)}
        self.ids, self.sizes = ids[found], np.array([len(split[i]) for i in found], dtype=np.int32)
        shape = (len(found), max(self.sizes, default=0))
        self.terms, self.places = np.full(shape, -1, dtype=np.int32), np.zeros(shape, dtype=np.int32)
        for row, i in enumerate(found):
            order = sorted(range(len(split[i])), key=lambda k, words=split[i]: (frequency[words[k]], k))
            self.terms[row, : len(order)] = [number[split[i][k]] for k in order]
            self.places[row, : len(order)] = order


def intersect(queries: _Queries, keys: np.ndarray, slop: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(window row, start, exact, place of the rarest word) of every place where all words of a window stand, up to `slop` off.

    `keys` are the sorted values word * 2^32 + position of one block.
    """
    bounds = np.searchsorted(keys, np.arange(len(queries.names) + 1, dtype=np.int64) << _PLACE)
    count = np.append(np.diff(bounds), 1)
    alive = np.flatnonzero((count[queries.terms] > 0).all(axis=1))
    if not len(alive):
        return
    amount = count[queries.terms[alive, 0]]
    part = np.cumsum(amount) * (2 * slop + 1) // _CANDIDATES
    for chosen in np.split(alive, np.flatnonzero(np.diff(part)) + 1):
        rare = queries.terms[chosen, 0]
        amount = count[rare]
        row = np.repeat(chosen, amount)
        at = np.arange(amount.sum()) - np.repeat(np.cumsum(amount) - amount, amount) + np.repeat(bounds[rare], amount)
        # The rarest word itself may be off its place by each step of the slop.
        shift = np.repeat(np.arange(-slop, slop + 1), len(row))
        row, anchor = np.tile(row, 2 * slop + 1), np.tile(keys[at] & ((1 << _PLACE) - 1), 2 * slop + 1)
        start, exact = anchor - queries.places[row, 0] + shift, shift == 0
        for j in range(1, queries.terms.shape[1]):
            term = queries.terms[row, j].astype(np.int64)
            want = (term << _PLACE) + start + queries.places[row, j]
            last = len(keys) - 1
            near = keys[np.minimum(np.searchsorted(keys, want - slop), last)]
            held = (term < 0) | ((near >= want - slop) & (near <= want + slop))
            if slop:
                exact &= (term < 0) | (keys[np.minimum(np.searchsorted(keys, want), last)] == want)
            row, start, exact, anchor = row[held], start[held], exact[held], anchor[held]
        if len(row):
            yield row, start, exact, anchor


def _search_rows(shared, gap: int, slop: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries: _Queries = shared.value
        number = {name: i for i, name in enumerate(queries.names)}
        for batch in batches:
            for block, sizes, terms, counts, postings in zip(batch["block"], batch["sizes"], batch["terms"], batch["counts"], batch["postings"]):
                ids = np.fromiter((number.get(t, -1) for t in terms), dtype=np.int64, count=len(terms))
                keys = (np.repeat(ids, counts) << _PLACE) + np.frombuffer(postings, dtype="<u4")
                keys = keys[np.repeat(ids >= 0, counts)]
                found = list(intersect(queries, keys, slop)) if len(keys) else []
                if found:
                    yield _document_rows(block, np.asarray(sizes, dtype=np.int64), gap, queries, *map(np.concatenate, zip(*found)))

    return run


def _document_rows(block: int, sizes: np.ndarray, gap: int, queries: _Queries, row: np.ndarray, start: np.ndarray, exact: np.ndarray, anchor: np.ndarray) -> pd.DataFrame:
    """Per document: the words that exact windows cover, as spans, and the windows met exactly or nearly."""
    begins = np.cumsum(sizes + gap) - sizes - gap
    doc = np.searchsorted(begins, anchor, side="right") - 1
    order = np.lexsort((start, doc))
    row, start, exact, doc = row[order], start[order], exact[order], doc[order]
    rows = []
    for d, low, high in zip(*_slices(doc)):
        mine = row[low:high]
        hit = exact[low:high]
        first, last = start[low:high][hit] - begins[d], start[low:high][hit] - begins[d] + queries.sizes[mine[hit]]
        reach = np.maximum.accumulate(last) if len(last) else last
        new = np.flatnonzero(np.append(True, first[1:] > reach[:-1])) if len(first) else np.zeros(0, dtype=np.int64)
        end = reach[np.append(new[1:], len(first)) - 1] if len(first) else reach
        rows.append((block, d, first[new].astype(np.int32), (end - first[new]).astype(np.int32), queries.ids[np.unique(mine[hit])], queries.ids[np.unique(mine)]))
    return pd.DataFrame(rows, columns=["block", "doc", "starts", "lengths", "windows", "near"])


def _slices(sorted_values: np.ndarray) -> tuple[list, list, list]:
    low = np.flatnonzero(np.append(True, np.diff(sorted_values) != 0))
    return sorted_values[low].tolist(), low.tolist(), np.append(low[1:], len(sorted_values)).tolist()


def search_index(index: DataFrame, phrases: DataFrame, gap: int = WINDOW, slop: int = 0, chunk_windows: int = CHUNK_WINDOWS) -> DataFrame:
    """Rows (block, doc, starts, lengths, windows, near) of documents that hold windows of (window_id, phrase).

    `starts` and `lengths` are the spans of words that exact occurrences cover, `windows`
    the ids of these windows, `near` those whose words all stand within `slop` words of
    their place. Windows are searched `chunk_windows` at a time against all blocks, so
    a large test set gives several rows per document. `gap` is that of the index and
    must not be below the longest window and twice the slop.
    """
    spark = index.sparkSession
    counts = cut_lineage(
        index.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("n")), "frequencies"
    )
    chunks = math.ceil(phrases.count() / chunk_windows)
    found = spark.createDataFrame([], _FOUND)
    for i in range(chunks):
        mine = phrases.filter(F.pmod(F.xxhash64("phrase"), F.lit(chunks)) == i)
        terms = mine.select(F.explode(F.split("phrase", " ")).alias("term")).distinct()
        frequency = {r["term"]: r["n"] for r in counts.join(terms, "term", "left_semi").collect()}
        rows = mine.collect()
        queries = _Queries(np.array([r["window_id"] for r in rows], dtype=np.int64), [r["phrase"] for r in rows], frequency)
        if not len(queries.ids):
            continue
        if gap < queries.terms.shape[1] + 2 * slop:
            raise ValueError("the index leaves too few positions between documents for these windows")
        shared = spark.sparkContext.broadcast(queries)
        # The next chunk's job starts after this one's rows are written, so one broadcast is held at a time.
        lists = index.select("block", "sizes", "terms", "counts", "postings")
        met = cut_lineage(lists.mapInPandas(_search_rows(shared, gap, slop), _FOUND), "matches")
        shared.unpersist()
        found = met if i == 0 else found.unionByName(met)
    return found


def _covered(spans):
    """Words under an array of (start, end) spans that may overlap."""
    zero = F.lit(0).cast("bigint")
    begin = F.struct(zero.alias("end"), zero.alias("total"))

    def step(state, span):
        free = F.greatest(span["end"] - F.greatest(span["start"], state["end"]), zero)
        return F.struct(F.greatest(state["end"], span["end"]).alias("end"), (state["total"] + free).alias("total"))

    return F.aggregate(F.array_sort(spans), begin, step, lambda s: s["total"])


def contaminated_documents(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    slop: int = 0,
    block_words: int = BLOCK_WORDS,
    chunk_windows: int = CHUNK_WINDOWS,
) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted texts), near_items.

    Words are lower-cased (A-Z) runs of digits, letters and characters beyond ASCII. A
    window is `window` words of an item, or all of a shorter one. `n_hit` counts the
    document's words inside exact occurrences of windows, `items` the items that own
    them; `near_items` also those with a window whose words all stand within `slop`
    words of their place. Null and empty texts have no words; items without words are
    never found; an item without an id marks words but is not listed; items that share
    an id are one. Rows that repeat an id or have none are judged one by one. Empty
    tables give no rows or no hits. Other columns are ignored.
    """
    gap = window + 2 * slop
    phrases, owners = test_windows(items, item_id_col, item_text_col, window)
    owners = cut_lineage(owners.filter("item is not null"), "owners")
    words = phrases.select(F.explode(F.split("phrase", " ")).alias("w")).distinct().limit(VOCABULARY + 1).collect()
    known = sorted((r["w"] for r in words), key=lambda w: w.encode("utf-8", "surrogatepass")) if len(words) <= VOCABULARY else None
    index = build_index(docs, id_col, text_col, known, gap, block_words)
    found = search_index(index, phrases, gap, slop, chunk_windows)

    ends = F.transform(F.arrays_zip("starts", "lengths"), lambda s: F.struct(s["starts"].cast("bigint").alias("start"), (s["starts"] + s["lengths"]).cast("bigint").alias("end")))
    hits = found.groupBy("block", "doc").agg(_covered(F.flatten(F.collect_list(ends))).alias("n_hit"))

    met = found.select("block", "doc", F.explode("near").alias("window_id"), "windows")
    met = met.select("block", "doc", "window_id", F.array_contains("windows", F.col("window_id")).alias("exact"))
    owned = lookup_join(met, owners, ["window_id"], "inner").groupBy("block", "doc", "item").agg(F.max("exact").alias("exact"))
    listed = owned.groupBy("block", "doc").agg(
        F.sort_array(F.collect_list(F.when(F.col("exact"), F.col("item")))).alias("items"), F.sort_array(F.collect_list("item")).alias("near_items")
    )
    every = index.select("block", F.posexplode(F.arrays_zip("doc_ids", "sizes")).alias("doc", "d"))
    every = every.select("block", "doc", F.col("d.doc_ids").alias("_id"), F.col("d.sizes").cast("bigint").alias("n_words"))
    nothing = F.array().cast("array<string>")
    joined = every.join(hits, ["block", "doc"], "left").join(listed, ["block", "doc"], "left")
    return joined.select(
        F.col("_id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce("items", nothing).alias("items"), F.coalesce("near_items", nothing).alias("near_items"),
    )
