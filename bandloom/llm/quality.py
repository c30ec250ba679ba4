"""Quality scores by a factorisation machine over words, structure and metadata.

A text is a sparse vector: hashed lower-case words, one-hot steps of structure
statistics, one-hot steps of metadata columns. The score is the logistic of a
linear term and of all pairwise interactions, whose weights are products of
low-rank factors; the sum-of-squares identity scores them in time linear in the
entries: sum over factors of ((sum v x)^2 - sum (v x)^2) / 2.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.llm.positions import KEY_BITS, order_key

WORD_SLOTS = 1 << 15
STEPS = 16
RANK = 8
# Bound on the labelled rows that a model is fitted on.
FIT_ROWS = 6000
EPOCHS = 12
THRESHOLD = 0.3
FOLDS = 5
STATISTICS = (
    "length", "words", "word_length", "upper", "digit", "mark", "symbol", "bar", "beyond", "space",
    "distinct", "top_word", "same_neighbour", "distinct_windows", "line_length", "same_lines",
)

_KINDS = np.zeros((256, 8))
for _b in range(256):
    _c = chr(_b)
    _kind = (
        0 if "A" <= _c <= "Z" else 1 if "0" <= _c <= "9" else 2 if _c in ".,;:!?'\"()-" else 3 if _c == "|" else 4 if 32 < _b < 127 and not _c.isalnum()
        else 5 if _b > 127 else 6 if _c in " \t\n\r\x0b\x0c" else 7
    )
    _KINDS[_b, _kind] = 1


def structure(text: str, words: list[str], counts: Counter) -> list[float]:
    """Values of STATISTICS, each from 0 to 1."""
    raw = text.encode("utf-8", "surrogatepass")
    size, n = max(len(raw), 1), max(len(words), 1)
    share = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _KINDS / size
    lines = [x for x in text.split("\n") if x.strip()]
    windows = max(len(words) - 2, 1)
    return [
        min(math.log2(size) / 24, 1.0), min(math.log2(n) / 20, 1.0), min(len(raw) / n / 20, 1.0),
        share[0], share[1], share[2], share[4], share[3], share[5], share[6],
        len(counts) / n, max(counts.values(), default=0) / n,
        sum(a == b for a, b in zip(words, words[1:])) / n,
        len(set(zip(words, words[1:], words[2:]))) / windows,
        min(math.log2(1 + n / max(len(lines), 1)) / 12, 1.0),
        1 - len(set(lines)) / max(len(lines), 1),
    ]


def features(text: str | None, metadata: Sequence[float | None], slots: int, known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sparse vector (places, values): words first, then steps of the statistics and of the metadata."""
    text = text or ""
    words = text.lower().split()
    counts = Counter(words)
    if len(known) > 300_000:
        known.clear()
    for w in counts:
        if w not in known:
            known[w] = xxhash.xxh32_intdigest(w.encode("utf-8", "surrogatepass"), 7) % slots
    bag: Counter = Counter()
    for w, c in counts.items():
        bag[known[w]] += math.log1p(c)
    norm = math.sqrt(sum(v * v for v in bag.values())) or 1.0
    places, values = list(bag), [v / norm for v in bag.values()]
    values_of = structure(text, words, counts)
    # Shares crowd near zero, so their steps follow the square root.
    steps = [min(int(math.sqrt(max(v, 0.0)) * (STEPS - 1) + 0.5), STEPS - 1) for v in values_of]
    for m in metadata:
        missing = m is None or m != m
        steps.append(0 if missing else 1 + min(int(math.log2(1 + abs(float(m)))), STEPS - 2))
    weight = 1 / math.sqrt(len(steps))
    places += [slots + i * STEPS + s for i, s in enumerate(steps)]
    values += [weight] * len(steps)
    return np.array(places, dtype=np.int32), np.array(values, dtype=np.float32)


@dataclass
class FactorModel:
    """Weights of a factorisation machine; plain arrays, so that it can be shipped to tasks."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    slots: int

    def margin(self, places: np.ndarray, values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Margins of rows laid end to end; row i is places[cuts[i]:cuts[i + 1]], never empty."""
        scaled = self.factors[places] * values[:, None]
        sums = np.add.reduceat(scaled, cuts[:-1])
        squares = np.add.reduceat(scaled * scaled, cuts[:-1])
        return self.bias + np.add.reduceat(self.linear[places] * values, cuts[:-1]) + 0.5 * (sums * sums - squares).sum(axis=1)


def _joined(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    cuts = np.cumsum([0, *[len(p) for p, _ in rows]])
    return np.concatenate([p for p, _ in rows]), np.concatenate([v for _, v in rows]).astype(np.float64), cuts


def fit_factors(
    rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, slots: int, width: int, rank: int = RANK, epochs: int = EPOCHS, seed: int = 5
) -> FactorModel:
    """Logistic fit by Adagrad on small batches, in a seeded order, with decay of weights in use."""
    random = np.random.RandomState(seed)
    positive = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    model = FactorModel(math.log(positive / (1 - positive)), np.zeros(width), random.normal(scale=0.05, size=(width, rank)), slots)
    if len(set(labels.tolist())) < 2:
        model.factors[:] = 0
        return model
    grown_linear, grown_factors, grown_bias = np.full(width, 1e-6), np.full((width, rank), 1e-6), 1e-6
    rate, decay = 0.1, 1e-4
    for _ in range(epochs):
        order = random.permutation(len(rows))
        for at in range(0, len(order), 64):
            picked = order[at : at + 64]
            places, values, cuts = _joined([rows[i] for i in picked])
            error = 1 / (1 + np.exp(-model.margin(places, values, cuts))) - labels[picked]
            each = np.repeat(error, np.diff(cuts)) / len(picked)
            scaled = model.factors[places] * values[:, None]
            sums = np.repeat(np.add.reduceat(scaled, cuts[:-1]), np.diff(cuts), axis=0)
            used, back = np.unique(places, return_inverse=True)
            slope = np.bincount(back, each * values, minlength=len(used)) + decay * model.linear[used]
            slopes = (each * values)[:, None] * (sums - scaled)
            slopes = np.stack([np.bincount(back, s, minlength=len(used)) for s in slopes.T], axis=1) + decay * model.factors[used]
            grown_linear[used] += slope**2
            grown_factors[used] += slopes**2
            model.linear[used] -= rate * slope / np.sqrt(grown_linear[used])
            model.factors[used] -= rate * slopes / np.sqrt(grown_factors[used])
            grown_bias += float(each.sum() if not len(error) else error.mean()) ** 2
            model.bias -= rate * float(error.mean()) / math.sqrt(grown_bias)
    return model


def _meta(docs: DataFrame, metadata_cols: Sequence[str]):
    return F.array(*[F.col(c).cast("double") for c in metadata_cols]) if metadata_cols else F.array().cast("array<double>")


def _feature_rows(slots: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            got = [features(t, m, slots, known) for t, m in zip(batch["text"], batch["meta"])]
            yield pd.DataFrame({"places": [p for p, _ in got], "values": [v for _, v in got], "label": batch["label"]})

    return run


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    metadata_cols: Sequence[str] = (), rows: int = FIT_ROWS, slots: int = WORD_SLOTS,
) -> FactorModel:
    """Fit on about `rows` labelled documents, the documented bound, chosen by a digest of the id.

    Null labels and ids are left out of the fit. Without any labelled document the
    score is one half everywhere, with labels of one kind it is their clipped share.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label")).filter("label is not null and _id is not null")
    count = known.count()
    share = min(1.0, rows / max(count, 1))
    chosen = known.filter(order_key(F.lit("fit"), F.col("_id")) < F.lit(int(share * (1 << KEY_BITS)))).limit(2 * rows)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("text"), _meta(docs, metadata_cols).alias("meta"))
    # At most twice `rows` ids are broadcast.
    sample = texts.join(F.broadcast(chosen), "_id").select("text", "meta", "label")
    got = sample.mapInPandas(_feature_rows(slots), "places array<int>, values array<float>, label double").orderBy("label", F.xxhash64("places", "values")).toPandas()
    width = slots + (len(STATISTICS) + len(metadata_cols)) * STEPS
    vectors = [(np.asarray(p, np.int64), np.asarray(v)) for p, v in zip(got["places"], got["values"])]
    return fit_factors(vectors, got["label"].to_numpy(dtype=float), slots, width)


def _score_rows(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model: FactorModel = shared.value
        known: dict[str, int] = {}
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                places, values, cuts = _joined([features(t, m, model.slots, known) for t, m in zip(part["text"], part["meta"])])
                margin = np.clip(model.margin(places, values, cuts), -700, 700)
                yield pd.DataFrame({"id": part["id"].astype("Int64"), "score": 1 / (1 + np.exp(-margin))})

    return run


def score_quality(
    docs: DataFrame, model: FactorModel, id_col: str = "doc_id", text_col: str = "text", metadata_cols: Sequence[str] = (), threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: id, score (0 to 1), predicted (1 from `threshold` on).

    Whole texts are scored, null and empty ones by their structure alone. Metadata
    that is null has a step of its own. Null and repeated ids are scored like any
    other; an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"), _meta(docs, metadata_cols).alias("meta"))
    scored = texts.mapInPandas(_score_rows(shared), "id bigint, score double")
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def held_out(id_col: str = "doc_id", folds: int = FOLDS):
    """Rows that no fit sees: crc32 of the id as text, modulo `folds`, is 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))
