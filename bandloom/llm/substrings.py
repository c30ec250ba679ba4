"""Repeated passages through a compacted graph of token windows.

The edges of the graph are windows of `window` words. Consecutive windows that
share a minimizer (the smallest hashed `token`-word k-mer inside) form a piece: a
path without branches whose place in the table is decided by its content alone, so
equal passages fall into equal pieces. Pieces that occur once are left behind by a
join with the k-mers that occur again. Equal pieces are one path, named by its
first source; pieces that share a k-mer but differ are opened into their windows.
Repeated pieces that follow each other both in a document and in their source are
compacted to one long span, which the source coordinates bear out.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandloom.llm.workers import freeing
from bandloom.session import cut_lineage

WINDOW = 20
TOKEN = 6
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_MODULUS = 1 << 64
_KNOWN = 300_000
# Words handled at a time: positions take the low 24 bits beside a k-mer's hash.
_PART_WORDS = 400_000
_LONGEST = 1 << 23
_PLACES = 24


def words_of(text: str | None) -> list[bytes]:
    """Runs without space and the controls 9-13, unchanged, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


class _Words(dict):
    """Numbers of words in order of arrival, with their hashes."""

    def __init__(self):
        super().__init__()
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self.hashes)
        self.hashes.append(xxhash.xxh64_intdigest(word))
        return number

    def of(self, split: list[list[bytes]], count: int) -> np.ndarray:
        if len(self) > _KNOWN:
            self.clear()
            self.hashes.clear()
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(split)), dtype=np.int32, count=count)
        return np.array(self.hashes, dtype=np.uint64)[numbers] if count else np.zeros(0, np.uint64)


@lru_cache(maxsize=8)
def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base % _MODULUS, dtype=np.uint64)
    steps[:1] = 1
    return np.cumprod(steps, dtype=np.uint64)


class _Sums:
    """Hashes of any stretch of a word sequence from prefix sums, modulo 2^64."""

    def __init__(self, hashes: np.ndarray, base: int):
        n = len(hashes) + 1
        # Powers are kept by size class, so that parts of similar size share them.
        size = 1 << (n - 1).bit_length()
        self.back = _powers(pow(base, -1, _MODULUS), size)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(hashes * _powers(base, size)[: n - 1], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[start]) * self.back[start])

    def all(self, length: int) -> np.ndarray:
        """Hashes of every stretch of `length` words."""
        return _mixed((self.sums[length:] - self.sums[:-length]) * self.back[: len(self.sums) - length])


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _sliding_least(x: np.ndarray, span: int) -> np.ndarray:
    """Least value of every `span` neighbours, by doubling."""
    width = 1
    while 2 * width <= span:
        x = np.minimum(x[:-width], x[width:])
        width *= 2
    return np.minimum(x[: len(x) - (span - width)], x[span - width :]) if width < span else x


def cut_pieces(hashes: np.ndarray, ends: np.ndarray, window: int, token: int) -> tuple[np.ndarray, ...]:
    """(start, windows, k-mer, content hash) of the pieces of documents laid end to end.

    `ends` holds the end of each document in the sequence. A window's minimizer is
    the k-mer with the least 40 leading hash bits, the left one of several, which
    depends on the window's words only.
    """
    none = (np.zeros(0, np.int64),) * 4
    if len(hashes) < window:
        return none
    sums = _Sums(hashes, _BASES[0])
    kmers = sums.all(token)
    low = np.uint64((1 << _PLACES) - 1)
    least = _sliding_least((kmers & ~low) | np.arange(len(kmers), dtype=np.uint64), window - token + 1)
    own = (least & low).astype(np.int64)
    inside = np.ones(len(own), dtype=bool)
    for end in ends[:-1].tolist():
        inside[max(0, end - window + 1) : end] = False
    starts = np.flatnonzero(inside)
    if not len(starts):
        return none
    own = own[starts]
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1))))
    first, windows = starts[new], np.diff(np.append(new, len(starts)))
    content = sums.of(first, first + windows + window - 1)
    return first, windows, kmers[own[new]].view(np.int64), content.view(np.int64)


def _parts(batch: pd.DataFrame, overlap: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[list[bytes]]]]:
    """(rows, first words, word lists) with a bounded number of words at a time.

    A very long text comes as stretches that share `overlap` words, so that every
    window lies in exactly one.
    """
    rows, firsts, held, size = [], [], [], 0
    for i, text in enumerate(batch["text"]):
        words = words_of(text)
        for first in range(0, max(len(words) - overlap, 1), _LONGEST):
            part = words if len(words) <= _LONGEST else words[first : first + _LONGEST + overlap]
            rows.append(i)
            firsts.append(first)
            held.append(part)
            size += len(part)
            if size >= _PART_WORDS:
                yield np.array(rows), np.array(firsts), held
                rows, firsts, held, size = [], [], [], 0
    if held:
        yield np.array(rows), np.array(firsts), held


def _piece_rows(window: int, token: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for batch in batches:
            place = batch["place"].to_numpy(np.int64)
            for rows, firsts, split in _parts(batch, window - 1):
                ends = np.cumsum([len(w) for w in split])
                start, windows, kmer, content = cut_pieces(known.of(split, int(ends[-1])), ends, window, token)
                doc = np.searchsorted(ends, start, side="right")
                begin = np.concatenate(([0], ends[:-1]))
                yield pd.DataFrame({
                    "kmer": kmer, "content": content, "place": place[rows[doc]],
                    "start": (start - begin[doc] + firsts[doc]).astype(np.int32), "windows": windows.astype(np.int32),
                })

    return freeing(run)


def _window_rows(window: int):
    """Hashes of the windows of opened pieces, packed as start * 2^16 + windows (pieces are short)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Words()
        for batch in batches:
            place, opened = batch["place"].to_numpy(np.int64), batch["opened"].to_numpy()
            for rows, firsts, split in _parts(batch, window - 1):
                size = np.array([len(w) for w in split])
                begin = np.cumsum(size) - size
                hashes = known.of(split, int(size.sum()))
                wanted = [np.asarray(opened[i], dtype=np.int64) for i in rows]
                doc = np.repeat(np.arange(len(rows)), [len(w) for w in wanted])
                start, windows = np.divmod(np.concatenate(wanted), 1 << 16)
                step = np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
                doc, start = np.repeat(doc, windows), np.repeat(start, windows) + step
                at = start - firsts[doc]
                fits = (at >= 0) & (at + window <= size[doc])
                doc, start, at = doc[fits], start[fits], (begin[doc] + at)[fits]
                one, two = (_Sums(hashes, base).of(at, at + window).view(np.int64) for base in _BASES)
                yield pd.DataFrame({"one": one, "two": two, "place": place[rows[doc]], "start": start.astype(np.int32)})

    return freeing(run)


@F.pandas_udf(T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("kept", T.StringType()),
]))
def _cut(texts: pd.Series, spans: pd.Series, with_text: pd.Series) -> pd.DataFrame:
    """Take the spans, packed as start * 2^32 + length, out of the words of each text."""
    rows = []
    for text, packed, wanted in zip(texts, spans, with_text):
        words = kept = words_of(text)
        if packed is not None and len(packed):
            edges = np.zeros(len(words) + 1, dtype=np.int64)
            start, length = np.divmod(np.asarray(packed, dtype=np.int64), 1 << 32)
            np.add.at(edges, np.minimum(start, len(words)), 1)
            np.add.at(edges, np.minimum(start + length, len(words)), -1)
            kept = [w for w, cover in zip(words, np.cumsum(edges[:-1]).tolist()) if not cover]
        left = b" ".join(kept)
        rows.append((len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "surrogatepass") if wanted else None))
    return pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256", "kept"])


def _place(id_col: str, text_col: str) -> Column:
    """Order of documents: the id; rows without one come last, by a digest of the text."""
    late = F.lit((1 << 63) - 1) - F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), 2)
    return F.coalesce(F.col(id_col).cast("bigint"), late)


def repeated_pieces(texts: DataFrame, window: int = WINDOW, token: int = TOKEN) -> DataFrame:
    """Pieces (kmer, content, place, start, windows, mixed) of (place, text) whose k-mer occurs again.

    `mixed` says that the k-mer also stands in a different piece. K-mers are counted
    with partial sums, so a passage that fills a third of the table stays cheap.
    """
    pieces = texts.mapInPandas(_piece_rows(window, token), "kmer bigint, content bigint, place bigint, start int, windows int")
    again = pieces.groupBy("kmer").agg(F.count("*").alias("n"), F.min("content").alias("low"), F.max("content").alias("high"))
    again = again.filter("n > 1").select("kmer", (F.col("low") != F.col("high")).alias("mixed"))
    # Written first: behind an aggregate of its own the join could not split a frequent k-mer.
    return pieces.join(cut_lineage(again, "kmers"), "kmer")


def _free_shuffles(df: DataFrame) -> None:
    """Let the context cleaner drop the shuffle files of steps whose result is written."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def removal_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, token: int = TOKEN) -> DataFrame:
    """Rows (place, start, length, source, source_start): stretches of words that stand earlier.

    Every word of a span lies in a window of `window` words whose sequence starts
    earlier, at a smaller id or further left in the same text. `source` and
    `source_start` tell where; they are null for windows of a piece that differs from its source.
    """
    texts = docs.select(_place(id_col, text_col).alias("place"), F.col(text_col).cast("string").alias("text"))
    pieces = cut_lineage(repeated_pieces(texts, window, token), "pieces")
    _free_shuffles(docs)
    paths = pieces.groupBy("kmer", "content").agg(F.min(F.struct("place", "start")).alias("first"), F.count("*").alias("n"))
    paths = cut_lineage(paths.filter("n > 1").select("kmer", "content", "first"), "paths")
    _free_shuffles(docs)
    known = pieces.join(paths, ["kmer", "content"], "left")
    later = F.coalesce(F.struct("place", "start") > F.col("first"), F.lit(False))

    # Compaction: pieces that follow each other here and in their source are one span.
    repeated = known.filter(later).select("place", "start", "windows", F.col("first.place").alias("source"), F.col("first.start").alias("source_start"))
    line = Window.partitionBy("place").orderBy("start")
    goes_on = (
        (F.lag("source").over(line) == F.col("source"))
        & (F.lag("start").over(line) + F.lag("windows").over(line) == F.col("start"))
        & (F.lag("source_start").over(line) + F.lag("windows").over(line) == F.col("source_start"))
    )
    repeated = repeated.withColumn("path", F.sum(F.when(goes_on, 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = repeated.groupBy("place", "path").agg(
        F.min("start").alias("start"), (F.max(F.col("start") + F.col("windows")) - F.min("start") + window - 1).alias("length"),
        F.first("source").alias("source"), F.min("source_start").alias("source_start"),
    )
    whole = whole.select("place", "start", "length", "source", "source_start")

    # First pieces with a k-mer that other pieces share: their windows decide one by one.
    piece = F.shiftleft(F.col("start").cast("bigint"), 16) + F.col("windows")
    opened = known.filter(~later & F.col("mixed")).groupBy("place").agg(F.collect_set(piece).alias("opened"))
    windows = texts.join(opened, "place").mapInPandas(_window_rows(window), "one bigint, two bigint, place bigint, start int")
    windows = cut_lineage(windows, "windows")
    _free_shuffles(docs)
    earliest = windows.groupBy("one", "two").agg(F.min(F.struct("place", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    earliest = cut_lineage(earliest.select("one", "two", "first"), "earliest")
    single = windows.join(earliest, ["one", "two"]).filter(F.struct("place", "start") > F.col("first"))
    single = single.select("place", "start", F.lit(window).alias("length"), F.col("first.place").alias("source"), F.col("first.start").alias("source_start"))
    return whole.unionByName(single)


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, token: int = TOKEN, with_text: bool = True, out: str = "cut"
) -> DataFrame:
    """The rows of `docs` and a struct `out`: n_words, n_removed, kept_sha256, kept (the words left, joined by spaces).

    A word goes if a window over it has a word sequence that also starts earlier.
    Null and empty texts have no words; texts shorter than a window lose nothing.
    Documents without an id come after all others. Rows that repeat an id with the
    same text are one place, so neither is the earlier one; with different texts
    under one id a span found in one is taken out of each. An empty table gives no
    rows. Other columns are carried along (only one that has the name of `out` is replaced);
    `kept` is null unless `with_text`.
    """
    packed = F.shiftleft(F.col("start").cast("bigint"), 32) + F.col("length")
    spans = removal_spans(docs, id_col, text_col, window, token).groupBy("place").agg(F.collect_list(packed).alias("spans"))
    rows = docs.select(_place(id_col, text_col).alias("place"), F.struct(*docs.columns).alias("row"))
    joined = rows.join(spans, "place", "left")
    joined = joined.select("row", _cut(F.col("row")[text_col].cast("string"), F.col("spans"), F.lit(with_text)).alias("cut"))
    return joined.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() != out.lower()], F.col("cut").alias(out))
