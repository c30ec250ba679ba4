"""Periodic runs of words by internal pattern matching.

Documents are laid end to end in parts of bounded size; a symbol is a word of one
document, so nothing repeats across documents. Prefix doubling ranks every stretch of
2^k words and ends in the suffix array. A run of period q in [2^k, 2^(k+1)) and four
periods or more holds an aligned block of 2^k words together with its copy q words
on. The block's suffixes are one range of the suffix array; a wavelet matrix over it
counts those that start in the window of the possible copies and selects the first,
second and last. Occurrences so close to each other are one arithmetic progression, and
its terms are the candidate periods. Each is extended to both sides through the
dyadic ranks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_LENGTH = 6
MIN_EXPONENT = 4
# Words worked on at a time; a longer document is a part of its own.
_PART_WORDS = 200_000

_FOUND = "n_words bigint, starts array<bigint>, lengths array<bigint>, periods array<bigint>, collapsed string"


def words_of(text: str | None) -> list[bytes]:
    """Runs without space and the controls 9-13, unchanged, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _group_starts(sorted_keys: np.ndarray) -> np.ndarray:
    """Per place of a sorted array the first place with the same value."""
    new = np.ones(len(sorted_keys), dtype=bool)
    new[1:] = sorted_keys[1:] != sorted_keys[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(sorted_keys)), 0))


def dyadic_ranks(symbols: np.ndarray) -> list[np.ndarray]:
    """Level k holds, per position, how many suffixes have smaller first 2^k symbols.

    Equal values mean equal stretches. Only positions whose stretch is not unique are
    sorted again; the last level has no equal values and is the inverse suffix array.
    """
    n = len(symbols)
    _, inverse, counts = np.unique(symbols, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts)[inverse].astype(np.int64)
    levels = [rank.astype(np.int32)]
    active, step = np.flatnonzero(counts[inverse] > 1), 1
    while len(active):
        after = active + step
        follow = np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        key = rank[active] * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        key, active = key[order], active[order]
        same, old = _group_starts(key), _group_starts(rank[active])
        rank = rank.copy()
        rank[active] += same - old
        levels.append(rank.astype(np.int32))
        active = active[np.bincount(same, minlength=len(same))[same] > 1]
        step *= 2
    return levels


class WaveletMatrix:
    """Counting and selection by value inside ranges of an array of numbers below its length."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.bits = n.bit_length()
        self.zeros: list[np.ndarray] = []
        for bit in reversed(range(self.bits)):
            is_zero = (values >> bit) & 1 == 0
            before = np.zeros(n + 1, dtype=np.int32)
            np.cumsum(is_zero, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate((values[is_zero], values[~is_zero]))

    def less(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many values in [low, high) are below `bound`."""
        total = np.zeros(len(low), dtype=np.int64)
        for before, bit in zip(self.zeros, reversed(range(self.bits))):
            one, a, b = (bound >> bit) & 1 == 1, before[low], before[high]
            total += np.where(one, b - a, 0)
            low, high = np.where(one, before[-1] + low - a, a), np.where(one, before[-1] + high - b, b)
        return total

    def nth(self, low: np.ndarray, high: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The value at `place` (from 0) of [low, high) in rising order."""
        value = np.zeros(len(low), dtype=np.int64)
        for before, bit in zip(self.zeros, reversed(range(self.bits))):
            a, b = before[low], before[high]
            right = place >= b - a
            value |= right.astype(np.int64) << bit
            place = place - np.where(right, b - a, 0)
            low, high = np.where(right, before[-1] + low - a, a), np.where(right, before[-1] + high - b, b)
        return value


def _common_after(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common stretch that starts at `a` and at `b` > `a`."""
    n, length = len(levels[0]), np.zeros(len(a), dtype=np.int64)
    for k in reversed(range(len(levels))):
        inside = b + length < n
        at = np.where(inside, length, 0)
        length += (inside & (levels[k][a + at] == levels[k][np.minimum(b + at, n - 1)])).astype(np.int64) << k
    return length


def _common_before(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common stretch that ends just before `a` and before `b` > `a`."""
    length = np.zeros(len(a), dtype=np.int64)
    for k in reversed(range(len(levels))):
        x = a - length - (1 << k)
        inside = x >= 0
        x = np.maximum(x, 0)
        length += (inside & (levels[k][x] == levels[k][x + b - a])).astype(np.int64) << k
    return length


def find_runs(symbols: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs, by start and period; exponents of 4 or more only."""
    if min_exponent < 4:
        raise ValueError("a block and its copy are sure to lie in runs of four periods or more only")
    none = (np.zeros(0, dtype=np.int64),) * 3
    n = len(symbols)
    if n < min_length:
        return none
    levels = dyadic_ranks(symbols)
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[levels[-1]] = np.arange(n)
    tree, starts, periods = None, [], []
    for k, rank in enumerate(levels):
        width = 1 << k
        block = np.arange(0, max(n - width, 0), width, dtype=np.int64)
        low = rank[block].astype(np.int64)
        size = np.bincount(rank, minlength=n)[low]
        # A run of four periods holds the block three times.
        often = size >= 3
        block, low, size = block[often], low[often], size[often]
        if not len(block):
            continue
        tree = tree or WaveletMatrix(suffixes)
        high = low + size
        first = tree.less(low, high, block + width)
        count = tree.less(low, high, np.minimum(block + 2 * width, n)) - first
        met = count > 0
        block, low, high, first, count = block[met], low[met], high[met], first[met], count[met]
        copy = tree.nth(low, high, first)
        second = tree.nth(low, high, first + np.minimum(count - 1, 1))
        terms = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        starts.append(np.repeat(block, count))
        periods.append(np.repeat(copy - block, count) + terms * np.repeat(second - copy, count))
    if not starts:
        return none
    at, period = np.concatenate(starts), np.concatenate(periods)
    before = _common_before(levels, at, at + period)
    start, length = at - before, before + period + _common_after(levels, at, at + period)
    long = length >= np.maximum(min_length, min_exponent * period)
    start, length, period = start[long], length[long], period[long]
    # One stretch found with several periods has the smallest; the others are its multiples.
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def _parts(texts: pd.Series) -> Iterator[list[list[bytes]]]:
    held, size = [], 0
    for text in texts:
        words = words_of(text)
        if held and size + len(words) > _PART_WORDS:
            yield held
            held, size = [], 0
        held.append(words)
        size += len(words)
    if held:
        yield held


def _part_rows(split: list[list[bytes]], min_length: int, min_exponent: int) -> list[tuple]:
    sizes = np.array([len(w) for w in split])
    ends = np.cumsum(sizes)
    begins, total = ends - sizes, int(ends[-1])
    numbers = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=total)
    start, length, period = find_runs(np.repeat(np.arange(len(split)), sizes) * len(numbers) + ids, min_length, min_exponent)
    edges = np.zeros(total + 1, dtype=np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    kept = np.cumsum(edges[:-1]) == 0
    low, high = np.searchsorted(start, begins), np.searchsorted(start, ends)
    rows = []
    for words, begin, end, a, b in zip(split, begins.tolist(), ends.tolist(), low.tolist(), high.tolist()):
        if a < b:
            words = compress(words, kept[begin:end].tolist())
        collapsed = b" ".join(words).decode("utf-8", "surrogatepass")
        rows.append((end - begin, start[a:b] - begin, length[a:b], period[a:b], collapsed))
    return rows


def _finder(min_length: int, min_exponent: int):
    @F.pandas_udf(_FOUND)
    def find(texts: pd.Series) -> pd.DataFrame:
        rows = [row for split in _parts(texts) for row in _part_rows(split, min_length, min_exponent)]
        return pd.DataFrame(rows, columns=["n_words", "starts", "lengths", "periods", "collapsed"])

    return find


def mark_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT, out: str = "runs") -> DataFrame:
    """The rows of `docs` with a struct `out`: n_words, starts, lengths, periods, collapsed.

    A run is a stretch of words with smallest period q that neither neighbour extends,
    of `min_length` words and `min_exponent` periods at least. The three arrays hold the
    runs by start and period, in word numbers from 0; `collapsed` is the text without
    the words that a run repeats (those after its first q), joined by one space. Null,
    empty and blank texts have no words, no runs and an empty `collapsed`. Rows are
    judged one by one, so repeated rows and ids give equal results; an empty table
    gives no rows. A column named `out` is replaced, all others stay. There is no
    shuffle; a task holds one part of about 200,000 words, or one longer document,
    with 4 bytes a word for each dyadic level its repeats reach.
    """
    kept = [c for c in docs.columns if c != out]
    # Behind a generator a text that is made by lambdas is ready before Python asks for it.
    rows = docs.select(F.struct(*kept).alias("row"), F.explode(F.array(F.col(text_col).cast("string"))).alias("text"))
    return rows.select("row.*", _finder(min_length, min_exponent)("text").alias(out))


def run_lines(runs: Column) -> Column:
    """`start,length,period` and a line break for every run of a struct of `mark_runs`."""
    zipped = F.arrays_zip(runs["starts"].alias("starts"), runs["lengths"].alias("lengths"), runs["periods"].alias("periods"))
    return F.array_join(F.transform(zipped, lambda r: F.concat(F.concat_ws(",", r["starts"], r["lengths"], r["periods"]), F.lit("\n"))), "")


def greatest_run(runs: Column) -> Column:
    """Struct (start, length, period) of the longest run, of several the first, then of least period; null if there is none."""
    zipped = F.arrays_zip(runs["starts"].alias("starts"), runs["lengths"].alias("lengths"), runs["periods"].alias("periods"))
    keyed = F.array_max(F.transform(zipped, lambda r: F.struct(r["lengths"].alias("length"), (-r["starts"]).alias("start"), (-r["periods"]).alias("period"))))
    return F.when(F.size(runs["starts"]) > 0, F.struct((-keyed["start"]).alias("start"), keyed["length"].alias("length"), (-keyed["period"]).alias("period")))
