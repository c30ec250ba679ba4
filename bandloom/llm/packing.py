"""Best-fit packing of token sequences by bin completion on the histogram of lengths.

Texts become token pieces in tasks. Which lengths share a sequence depends on the
histogram of lengths only, and that has at most `limit` entries whatever the size
of the table. Bin completion searches the histogram: around the largest length left
it enumerates fillings, larger lengths first, drops those that another filling
dominates or that cannot beat the waste of the best one so far, and starts from the
best-fit filling; a long search is settled by the sums that can be reached. A filling is used as often as its lengths last. Pieces then find
their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Mapping
from itertools import chain, compress

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.llm.positions import cell_widths, order_key, running_sum
from bandloom.llm.workers import freeing
from bandloom.session import cut_lineage

LIMIT = 4096
END_ID = 1
# Fillings looked at by branch and bound before the table of reachable sums decides.
SEARCH_NODES = 400
# Words whose ids are kept; when there are more, the most frequent half stays, and
# between partitions the most frequent of all.
_CACHED_WORDS = 400_000
_IDLE_WORDS = 50_000
_CHUNK_WORDS = 1000
# Characters that are not lower-cased one by one, or may combine with others.
_SPECIAL = re.compile("[\u0130\u0250-\U0010ffff]")
# A full stop or comma after a letter is a token run of its own.
_STOP = re.compile("[.,](?<=[a-z\xdf-\xf6\xf8-\xff][.,])(?= |$)")

_coders: dict[str, _Coder] = {}


class _Numbers(dict):
    """Words numbered in order of arrival; `new` lists those not learned yet."""

    def __init__(self, words=()):
        super().__init__(zip(words, range(len(words))))
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


class _Coder:
    """A tokenizer and the ids of words met before.

    The tokenizer lower-cases, drops white space and never joins across it, so the ids of a
    text are those of its words in a row. Texts of letters below U+0250 are lower-cased
    whole, and full stops and commas are set apart, which leaves few different words.
    """

    def __init__(self, path: str):
        # A task has one core.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.forget()

    def forget(self) -> None:
        self.numbers = _Numbers()
        self.flat, self.starts, self.sizes, self.uses = np.zeros(0, "<u4"), *(np.zeros(0, np.int64) for _ in range(3))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _simple(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, sizes) of lower-case words of letters, many encoded at once and cut after each word's last token."""
        chunks = [words[at : at + _CHUNK_WORDS] for at in range(0, len(words), _CHUNK_WORDS)]
        for chunk, ids in zip(chunks, self.ids([" ".join(c) for c in chunks])):
            ends = np.flatnonzero(self.closes[ids]) + 1
            if len(ends) == len(chunk):
                yield ids, np.diff(ends, prepend=0)
            else:
                apart = self.ids(chunk)
                yield np.concatenate(apart), np.array([len(x) for x in apart])

    def _learn(self, special: bool) -> None:
        new, self.numbers.new = self.numbers.new, []
        simple = [w.isalpha() and w.islower() for w in new]
        if special:
            simple = [x and not _SPECIAL.search(w) for x, w in zip(simple, new)]
        odd = self.ids(list(compress(new, (not x for x in simple))))
        found = [*self._simple(list(compress(new, simple))), (np.concatenate(odd or [self.flat[:0]]), np.array([len(x) for x in odd], dtype=np.int64))]
        # Simple words first, then the others; `place` leads back to the order of arrival.
        simple = np.array(simple)
        place = np.concatenate((np.flatnonzero(simple), np.flatnonzero(~simple)))
        sizes = np.concatenate([n for _, n in found])
        own, starts = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        own[place], starts[place] = sizes, np.cumsum(sizes) - sizes + len(self.flat)
        self.flat = np.concatenate((self.flat, *(ids for ids, _ in found)))
        self.sizes, self.starts = np.append(self.sizes, own), np.append(self.starts, starts)
        self.uses = np.append(self.uses, np.zeros(len(new), np.int64))

    def shrink(self, most: int) -> None:
        """Keep the ids of the most frequent words and halve their counts."""
        kept = np.sort(np.argsort(-self.uses, kind="stable")[:most])
        words = list(self.numbers)
        self.numbers = _Numbers([words[i] for i in kept.tolist()])
        self.flat = self._gathered(kept)
        self.sizes, self.uses = self.sizes[kept], self.uses[kept] // 2
        self.starts = np.cumsum(self.sizes) - self.sizes

    def _gathered(self, numbers: np.ndarray) -> np.ndarray:
        sizes = self.sizes[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[numbers] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]

    def encode(self, texts: list[str]) -> list[bytes]:
        flat = [t.replace("\n", " ") for t in texts]
        special = [_SPECIAL.search(t) is not None for t in flat]
        split = [(t if odd else _STOP.sub(r" \g<0>", t.lower())).split(" ") for t, odd in zip(flat, special)]
        if len(self.numbers) > _CACHED_WORDS:
            self.shrink(_CACHED_WORDS // 2)
        ends = np.cumsum([len(words) for words in split])
        numbers = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), dtype=np.int64, count=int(ends[-1]))
        if self.numbers.new:
            self._learn(any(special))
        self.uses += np.bincount(numbers, minlength=len(self.uses))
        ids = self._gathered(numbers)
        stops = np.append(0, np.cumsum(self.sizes[numbers]))[ends].tolist()
        return [ids[a:b].tobytes() for a, b in zip([0, *stops[:-1]], stops)]


def coder(path: str) -> _Coder:
    """The tokenizer of this process; reading its file takes longer than many texts."""
    if path not in _coders:
        _coders[path] = _Coder(path)
    return _coders[path]


def token_bytes(texts: list[str], path: str) -> list[bytes]:
    """Token ids of texts as little-endian unsigned 32-bit integers."""
    return coder(path).encode(texts) if texts else []


def _pieces(path: str, limit: int, end_id: int, keep_ids: bool):
    end = np.array([end_id], dtype="<u4").tobytes()

    def rows(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for at in range(0, len(batch), 500):
            part = batch.iloc[at : at + 500]
            rows = []
            for doc, ids in zip(part["id"], token_bytes([t or "" for t in part["text"]], path)):
                ids += end
                for piece, start in enumerate(range(0, len(ids) // 4, limit)):
                    cut = ids[4 * start : 4 * (start + limit)]
                    row = (doc, piece, start, len(cut) // 4, zlib.crc32(cut))
                    rows.append((*row, cut) if keep_ids else row)
            names = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
            yield pd.DataFrame(rows, columns=names).astype({"id": "Int64", "piece": "int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        try:
            for batch in batches:
                yield from rows(batch)
        finally:
            # Workers outlive their partitions; what they hold in between is small.
            coder(path).shrink(_IDLE_WORDS)

    return freeing(run)


def token_pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """Rows (id, piece, start, length, ids_crc32[, ids]): ids of each text and an end id, cut at `limit`."""
    schema = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if keep_ids else "")
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInPandas(_pieces(tokenizer, limit, end_id, keep_ids), schema)


def complete_bin(room: int, lengths: list[int], counts: Mapping[int, int], nodes: int = SEARCH_NODES) -> list[tuple[int, int]]:
    """The filling of `room` with the least waste, as (length, times).

    `lengths` are the available lengths in rising order. Branch and bound opens the
    fullest choice of the largest length first, so best fit is the first incumbent,
    and cuts a branch when all it can still add does not beat it. A filling that
    leaves out something that fits is dominated by the one with it and never stands. After
    `nodes` branches the sums that the lengths can reach decide, which is exact as well.
    """
    best: list[tuple[int, int]] = []
    best_left, seen = room, 0
    mass = [0]
    for length in lengths:
        mass.append(mass[-1] + length * counts[length])
        if mass[-1] >= room:
            break
    stack: list[tuple[int, int, tuple[tuple[int, int], ...]]] = [(room, len(lengths), ())]
    while stack and best_left:
        if seen == nodes:
            return _fullest(room, lengths, counts)
        left, below, chosen = stack.pop()
        seen += 1
        if left < best_left:
            best_left, best = left, list(chosen)
        at = bisect_right(lengths, left, 0, below)
        if not at or left - mass[min(at, len(mass) - 1)] >= best_left:
            continue
        length = lengths[at - 1]
        most = min(left // length, counts[length])
        if at > 1:
            # Fewer copies are pushed first, so that the fullest choice is opened first.
            stack.extend((left - n * length, at - 1, (*chosen, (length, n)) if n else chosen) for n in range(most))
        stack.append((left - most * length, at - 1, (*chosen, (length, most))))
    return best


def _fullest(room: int, lengths: list[int], counts: Mapping[int, int]) -> list[tuple[int, int]]:
    """The largest sum up to `room`, from bits of reachable sums; larger lengths are preferred."""
    whole = (1 << (room + 1)) - 1
    fitting = [length for length in lengths if length <= room]
    reach = [1]
    for length in fitting:
        bits, copies, step = reach[-1], min(counts[length], room // length), 1
        while copies:
            step = min(step, copies)
            bits |= (bits << (length * step)) & whole
            copies, step = copies - step, 2 * step
        reach.append(bits)
    left, filling = reach[-1].bit_length() - 1, []
    for i in reversed(range(len(fitting))):
        length = fitting[i]
        times = next(n for n in range(min(counts[length], left // length), -1, -1) if reach[i] >> (left - n * length) & 1)
        if times:
            filling.append((length, times))
            left -= times * length
    return filling


def packing_plan(histogram: Mapping[int, int], limit: int = LIMIT) -> tuple[np.ndarray, int]:
    """Slots (length, first rank, pieces per sequence, first sequence, offset) and the number of sequences."""
    counts = {int(k): int(v) for k, v in histogram.items() if v > 0}
    lengths = sorted(counts)
    used = dict.fromkeys(lengths, 0)
    slots, sequences = [], 0
    while lengths:
        largest = lengths[-1]
        counts[largest] -= 1
        filling = complete_bin(limit - largest, lengths if counts[largest] else lengths[:-1], counts)
        counts[largest] += 1
        times = dict(filling)
        times[largest] = times.get(largest, 0) + 1
        repeat = min(counts[k] // n for k, n in times.items())
        offset = 0
        for length in sorted(times, reverse=True):
            n = times[length]
            slots.append((length, used[length], n, sequences, offset))
            used[length] += n * repeat
            counts[length] -= n * repeat
            offset += n * length
            if not counts[length]:
                lengths.remove(length)
        sequences += repeat
    table = np.array(sorted(slots), dtype=np.int64).reshape(-1, 5)
    return table, sequences


_RANKS = 1 << 48


def _place(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = shared.value
        starts = plan[:, 0] * _RANKS + plan[:, 1]
        for batch in batches:
            if not len(batch):
                continue
            length, rank = batch["length"].to_numpy(np.int64), batch["rank"].to_numpy(np.int64)
            slot = plan[np.searchsorted(starts, length * _RANKS + rank, side="right") - 1]
            turn, place = np.divmod(rank - slot[:, 1], slot[:, 2])
            yield batch.drop(columns="rank").assign(sequence_id=slot[:, 3] + turn, offset=slot[:, 4] + place * length)

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, end_id: int = END_ID, keep_ids: bool = False
) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).

    A document is the tokenizer's ids, then `end_id`; only documents longer than
    `limit` are cut, into pieces of `limit` ids with a shorter last one. Null and
    empty texts are the end id alone. Null ids are packed like others; rows that
    repeat an id are packed each. An empty table gives no rows. Pieces of one length
    are interchangeable, so their rank in a seeded order decides which sequence they
    fill; sequence ids run from 0, offsets from 0 without gaps. Other columns are
    ignored. The tokenizer's file must lie at the same path on every executor.
    """
    spark = docs.sparkSession
    pieces = cut_lineage(token_pieces(docs, tokenizer, id_col, text_col, limit, end_id, keep_ids), "pieces")
    # At most `limit` rows, whatever the table.
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    plan, _ = packing_plan(histogram, limit)
    keyed = pieces.withColumn("key", order_key(F.col("id"), F.col("piece"))).withColumn("one", F.lit(1).cast("bigint"))
    ranked = running_sum(keyed, ["length"], "key", "one", "rank", cell_widths(sum(histogram.values())), ties=("id", "piece", "ids_crc32"))
    columns = ["id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    kinds = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + (", ids binary" if keep_ids else "")
    shared = spark.sparkContext.broadcast(plan)
    placed = ranked.select(*columns, "rank").mapInPandas(_place(shared), f"{kinds}, sequence_id bigint, offset bigint")
    return placed.withColumnRenamed("id", id_col)
