"""Fill-in-middle samples cut at unit boundaries that a Roaring-style set holds.

The boundaries of a text (code points before the end of each line) are split by their
high 16 bits into containers. A container is an array, a bitmap or a list of runs,
whichever is smallest, and cumulative cardinalities lead to the container of the k-th
boundary. Both cuts of a document are two selections. Python sees the text and returns
two offsets; pieces are cut and joined by Spark.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7
_LOW = 1 << 16
_BITMAP_BYTES = _LOW // 8


@dataclass
class ArrayContainer:
    """Low halves of few scattered values."""

    low: np.ndarray

    def select(self, k: np.ndarray) -> np.ndarray:
        return self.low[k].astype(np.int64)


@dataclass
class BitmapContainer:
    """One bit per low half, with the bits set before each word of 64."""

    words: np.ndarray
    before: np.ndarray

    @classmethod
    def of(cls, low: np.ndarray) -> BitmapContainer:
        bits = np.zeros(_LOW, dtype=np.uint8)
        bits[low] = 1
        words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        return cls(words, np.cumsum(counts) - counts)

    def select(self, k: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.before, k, side="right") - 1
        bits = np.unpackbits(self.words[at].reshape(-1, 1).view(np.uint8), axis=1, bitorder="little")
        inside = np.argmax(np.cumsum(bits, axis=1) > (k - self.before[at]).reshape(-1, 1), axis=1)
        return 64 * at + inside


@dataclass
class RunContainer:
    """Stretches of consecutive low halves, with the values before each."""

    first: np.ndarray
    before: np.ndarray

    def select(self, k: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.before, k, side="right") - 1
        return self.first[at].astype(np.int64) + k - self.before[at]


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest form: 2 bytes a value, 4 bytes a run, or 8 KB."""
    new = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    if 4 * len(new) < min(2 * len(low), _BITMAP_BYTES):
        return RunContainer(low[new].astype(np.uint16), new)
    if 2 * len(low) <= _BITMAP_BYTES:
        return ArrayContainer(low.astype(np.uint16))
    return BitmapContainer.of(low)


class BoundarySet:
    """A sorted set of offsets below 2^32 with selection by place."""

    def __init__(self, values: np.ndarray):
        high = values >> 16
        starts = np.flatnonzero(np.diff(high, prepend=-1))
        self.keys = high[starts]
        self.before = starts
        self.size = len(values)
        self.containers = [container(part & (_LOW - 1)) for part in np.split(values, starts[1:])] if len(values) else []

    def select(self, k: Sequence[int]) -> np.ndarray:
        """The k-th values, from 0."""
        k = np.asarray(k, dtype=np.int64)
        at = np.searchsorted(self.before, k, side="right") - 1
        out = np.empty(len(k), dtype=np.int64)
        for c in set(at.tolist()):
            mine = at == c
            out[mine] = (self.keys[c] << 16) + self.containers[c].select(k[mine] - self.before[c])
        return out


def line_ends(text: str) -> np.ndarray:
    """Code points before the end of each line; a last line without a line break counts."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ends = np.flatnonzero(points == 10) + 1
    return ends if points[-1] == 10 else np.append(ends, len(points))


def char_ends(text: str) -> np.ndarray:
    return np.arange(1, len(text) + 1, dtype=np.int64)


UNITS = {"line": line_ends, "char": char_ends}


def _cutter(unit: str):
    ends_of = UNITS[unit]

    @F.pandas_udf("n bigint, first bigint, last bigint")
    def cut(texts: pd.Series, one: pd.Series, two: pd.Series) -> pd.DataFrame:
        rows = []
        for text, a, b in zip(texts, one.tolist(), two.tolist()):
            ends = BoundarySet(ends_of(text or ""))
            after = sorted((a % (ends.size + 1), b % (ends.size + 1)))
            chosen = [k - 1 for k in after if k]
            offsets = [0] * (2 - len(chosen)) + (ends.select(chosen).tolist() if chosen else [])
            rows.append((ends.size, *offsets))
        return pd.DataFrame(rows, columns=["n", "first", "last"])

    return cut


def draws(id_col: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers from the SHA-256 of `seed:id`; a null id counts as no digits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = SEED,
    percent: int = 100,
    spm_percent: int = 50,
    unit: str = "line",
    sentinels: Sequence[str] = SENTINELS,
    out: str = "infill",
) -> DataFrame:
    """The rows of `docs` with a struct `out`: n, form, prefix_chars, middle_chars, output.

    A text is n units: lines with their line break (or single code points). Two seeded
    draws per id choose after how many units the prefix and the middle end; the rest is
    the suffix. `percent` of the documents become `psm` (prefix, suffix, middle) or, in
    `spm_percent` of the cases, `spm` (suffix, prefix, middle), each piece behind its
    sentinel; others stay `plain`, and so do empty and null texts and texts that hold a
    sentinel. Plain rows have the text (null: empty) as output and null sizes. Pieces
    may be empty. Rows of one id and text become alike, null ids draw as an id without
    digits, an empty table gives no rows. A column named `out` is replaced, all others stay.
    """
    kept = [c for c in docs.columns if c != out]
    row = F.struct(*[F.col(c) for c in kept])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    drawn = docs.select(row.alias("row"), text.alias("text"), F.array(*draws(F.col(id_col), seed)).alias("h"))
    cut = drawn.select("*", _cutter(unit)(F.col("text"), F.get("h", F.lit(0)), F.get("h", F.lit(1))).alias("cut"))
    held = F.lit(False)
    for mark in sentinels:
        held = held | F.contains(F.col("text"), F.lit(mark))
    plain = (F.col("text") == "") | held | (F.get("h", F.lit(2)) % 100 >= percent)
    form = F.when(plain, "plain").when(F.get("h", F.lit(3)) % 100 < spm_percent, "spm").otherwise("psm")
    formed = cut.select("row", "text", "cut", form.alias("form"))
    first, last = F.col("cut.first").cast("int"), F.col("cut.last").cast("int")
    piece = lambda start, size: F.substring(F.col("text"), start + 1, size)
    p, s, m = (F.lit(mark) for mark in sentinels)
    prefix, middle = piece(F.lit(0), first), piece(first, last - first)
    suffix = piece(last, F.length("text") - last)
    output = (
        F.when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
        .when(F.col("form") == "spm", F.concat(s, suffix, p, prefix, m, middle))
        .otherwise(F.col("text"))
    )
    cuts = F.col("form") != "plain"
    made = F.struct(
        F.col("cut.n").alias("n"),
        F.col("form"),
        F.when(cuts, F.col("cut.first")).alias("prefix_chars"),
        F.when(cuts, F.col("cut.last") - F.col("cut.first")).alias("middle_chars"),
        output.alias("output"),
    )
    return formed.select("row.*", made.alias(out))


def restore_text(output: Column, form: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The text that `fill_in_middle` made `output` of; pieces hold no sentinel, so the split is exact."""
    pattern = "|".join(f"\\Q{mark}\\E" for mark in sentinels)
    part = lambda pieces, i: F.get(pieces, F.lit(i))
    ordered = lambda *order: F.get(F.transform(F.array(F.split(output, pattern, -1)), lambda x: F.concat(*[part(x, i) for i in order])), F.lit(0))
    return F.when(form == "psm", ordered(1, 3, 2)).when(form == "spm", ordered(2, 3, 1)).otherwise(output)
