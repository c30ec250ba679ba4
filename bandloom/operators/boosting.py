"""Second-order gradient boosting of a softmax loss on binned bands.

Every round grows one tree per class. All trees of a round grow a level at a time: a
job sums gradients, second derivatives and rows per (node, band, bin), first in the tasks,
and what reaches the driver grows with the open nodes and not with the table. Scores are kept with the binned rows; the trees of the last rounds are added
while rows are read, and every few rounds the scores are written anew.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.functions.matrix import matrix
from bandloom.operators.trees import Tree
from bandloom.session import cut_lineage

BINS = 32
# Rounds whose trees are added on the fly before scores are written again.
PENDING_ROUNDS = 10
# Sums that a task and the driver hold; the nodes of a wide level are taken in several jobs.
TASK_CELLS = 1_000_000


@dataclass
class BoostSettings:
    """What shapes the trees.

    leaf_l2 and min_gain enter the objective: a split must raise
    (sum g)^2 / (sum h + leaf_l2) / 2 over its node by more than min_gain. min_hessian
    is the least sum of second derivatives of a child, min_rows its least rows, split_rows
    the least rows of a node to be split. Symmetric trees use one band and
    threshold for a whole level. row_share and band_share are drawn anew each round.
    """

    rounds: int = 100
    depth: int = 3
    rate: float = 0.1
    leaf_l2: float = 1.0
    min_gain: float = 0.0
    min_hessian: float = 0.0
    min_rows: int = 1
    split_rows: int = 2
    row_share: float = 1.0
    band_share: float = 1.0
    symmetric: bool = False
    bins: int = BINS
    binning: str = "quantile"
    seed: int = 0


@dataclass
class Boosted:
    """Trees by round and class; `losses` is the mean log loss before the first and after every round."""

    trees: list[list[Tree]]
    rate: float
    outputs: int
    losses: list[float] = field(default_factory=list)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.outputs))
        for trees in self.trees:
            for k, tree in enumerate(trees):
                out[:, k] += self.rate * tree.value[tree.leaf(x), 0]
        return out


def softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bin_edges(df: DataFrame, d: int, bins: int = BINS, binning: str = "quantile") -> list[np.ndarray]:
    """Rising thresholds per band, at most bins - 1: approximate quantiles, or equal steps from least to largest."""
    b = [F.col("bands")[i] for i in range(d)]
    if not 2 <= bins <= 256:
        raise ValueError("bins must lie between 2 and 256")
    if binning == "width":
        row = df.agg(*[f(c) for c in b for f in (F.min, F.max)]).first()
        if row[0] is None:
            return [np.zeros(0)] * d
        return [np.unique([row[2 * i] + (row[2 * i + 1] - row[2 * i]) * j / bins for j in range(1, bins)]) for i in range(d)]
    if binning != "quantile":
        raise ValueError(f"unknown binning {binning!r}")
    shares = [j / bins for j in range(1, bins)]
    row = df.agg(*[F.percentile_approx(c, shares, 50 * bins) for c in b]).first()
    return [np.unique(v or []) for v in row]


def binned_rows(df: DataFrame, code: Column, edges: Sequence[np.ndarray], outputs: int) -> DataFrame:
    """(bins, code, weight, pick, score) with one byte per band and scores of zero; written to the shared folder."""
    d = len(edges)
    weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
    pick = F.xxhash64(*[c for c in ("sample_id",) if c in df.columns], "bands")
    rows = df.select("bands", code.cast("int").alias("code"), weight.alias("weight"), pick.alias("pick"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch, d)
                bins = np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(edges)], axis=1).astype(np.uint8)
                offsets = np.arange(0, (len(x) + 1) * d, d, dtype=np.int32)
                held = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(bins))])
                zero = pa.array([[0.0] * outputs] * len(x), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([held, batch["code"], batch["weight"], batch["pick"], zero], names=["bins", "code", "weight", "pick", "score"])

    return cut_lineage(rows.mapInArrow(run, "bins binary, code int, weight double, pick bigint, score array<double>"), "binned")


def _bins_of(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch["bins"].to_pylist()), dtype=np.uint8).reshape(batch.num_rows, d)


def _scores_of(batch: pa.RecordBatch, bins: np.ndarray, outputs: int, pending: Sequence[Sequence[Tree]], rate: float) -> np.ndarray:
    score = batch["score"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, outputs).copy()
    for trees in pending:
        for k, tree in enumerate(trees):
            score[:, k] += rate * tree.value[tree.leaf_of_bins(bins), 0]
    return score


def _rescored(rows: DataFrame, d: int, outputs: int, pending, rate: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(pending)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                score = _scores_of(batch, _bins_of(batch, d), outputs, shared.value, rate)
                yield batch.set_column(batch.schema.get_field_index("score"), "score", pa.array(list(score), pa.list_(pa.float64())))

    return cut_lineage(rows.mapInArrow(run, rows.schema), "scores")


_SUMS = "slot int, band int, bin int, g double, h double, n bigint"
_WHOLE = -1


def _gradient_sums(rows: DataFrame, d: int, outputs: int, pending, trees: Sequence[Tree], slots: Sequence[tuple[int, int]], bands: Sequence[int], settings: BoostSettings, draw: int) -> DataFrame:
    """Sums per (slot, band, bin) and, as slot _WHOLE, the log loss; a slot is a (class, node) pair."""
    shared = rows.sparkSession.sparkContext.broadcast((pending, list(trees), list(slots), np.asarray(bands)))
    rate, bins_most, row_share = settings.rate, settings.bins, settings.row_share

    def run(batches):
        pending, trees, slots, bands = shared.value
        cells = np.zeros((3, len(slots) * len(bands) * bins_most))
        loss = weight_sum = count = 0
        by_class = [np.full(len(tree.band), len(slots)) for tree in trees]
        for i, (k, node) in enumerate(slots):
            by_class[k][node] = i
        for batch in batches:
            if not batch.num_rows:
                continue
            bins = _bins_of(batch, d)
            p = softmax(_scores_of(batch, bins, outputs, pending, rate))
            code, weight = batch["code"].to_numpy(), batch["weight"].to_numpy()
            loss -= (weight * np.log(np.maximum(p[np.arange(len(p)), code], 1e-300))).sum()
            weight_sum, count = weight_sum + weight.sum(), count + len(p)
            if row_share < 1:
                seed = np.uint64((draw * 0x9E3779B97F4A7C15 + 1) % (1 << 64))
                mixed = (batch["pick"].to_numpy().view(np.uint64) ^ seed) * np.uint64(0xFF51AFD7ED558CCD)
                used = (mixed ^ (mixed >> np.uint64(32))) < np.uint64(int(row_share * (1 << 64)))
                bins, p, code, weight = bins[used], p[used], code[used], weight[used]
            at = np.arange(len(bands))
            for k in sorted({k for k, _ in slots}):
                slot = by_class[k][trees[k].leaf_of_bins(bins)]
                here = slot < len(slots)
                place = ((slot[here, None] * len(bands) + at) * bins_most + bins[here][:, bands]).ravel()
                own, w = p[here, k], weight[here]
                size = cells.shape[1]
                cells[0] += np.bincount(place, np.repeat((own - (code[here] == k)) * w, len(bands)), size)
                cells[1] += np.bincount(place, np.repeat(own * (1 - own) * w, len(bands)), size)
                cells[2] += np.bincount(place, minlength=size)
        met = np.flatnonzero(cells[2])
        slot, rest = np.divmod(met, len(bands) * bins_most)
        band, bin_ = np.divmod(rest, bins_most)
        frame = pd.DataFrame({"slot": slot, "band": bands[band], "bin": bin_, "g": cells[0][met], "h": cells[1][met], "n": cells[2][met]})
        if count:
            frame.loc[len(frame)] = [_WHOLE, 0, 0, loss, weight_sum, count]
        kinds = {"slot": "int32", "band": "int32", "bin": "int32", "n": "int64", "g": "float64", "h": "float64"}
        yield pa.RecordBatch.from_pandas(frame.astype(kinds), preserve_index=False)

    sums = rows.mapInArrow(run, _SUMS)
    return sums.groupBy("slot", "band", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


@dataclass
class _Sums:
    """Sums by (slot, band, bin) of one pass; as many numbers as the model has open nodes, bands and bins."""

    g: np.ndarray
    h: np.ndarray
    n: np.ndarray
    loss: float

    @classmethod
    def collected(cls, sums: DataFrame, slots: int, bands: Sequence[int], bins: int) -> _Sums:
        rows = sums.toArrow()
        slot, band, bin_, g, h, n = (rows.column(c).to_numpy() for c in ("slot", "band", "bin", "g", "h", "n"))
        whole = slot == _WHOLE
        loss = float(g[whole][0] / h[whole][0]) if whole.any() else 0.0
        at = (slot[~whole], np.searchsorted(np.asarray(bands), band[~whole]), bin_[~whole])
        cubes = [np.zeros((slots, len(bands), bins)) for _ in range(3)]
        for cube, values in zip(cubes, (g, h, n)):
            cube[at] = values[~whole]
        return cls(*cubes, loss)

    def totals(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.g[:, 0].sum(axis=1), self.h[:, 0].sum(axis=1), self.n[:, 0].sum(axis=1)


def _worth(g: np.ndarray, h: np.ndarray, leaf_l2: float) -> np.ndarray:
    whole = h + leaf_l2
    return np.divide(g * g, whole, out=np.zeros_like(g), where=whole > 1e-12)


def _best_splits(sums: _Sums, bands: Sequence[int], s: BoostSettings, groups: np.ndarray | None) -> list[tuple]:
    """Per slot (g, h, n) and (band, bin, left g, left h, left n) of its best split, or None.

    For symmetric trees `groups` numbers the slots that share a split; the gain of a
    threshold is summed over them. The smaller band, then the smaller threshold wins ties.
    """
    g, h, n = (x[:, None, None] for x in sums.totals())
    gl, hl, nl = (np.cumsum(x, axis=2) for x in (sums.g, sums.h, sums.n))
    gain = (_worth(gl, hl, s.leaf_l2) + _worth(g - gl, h - hl, s.leaf_l2) - _worth(g, h, s.leaf_l2)) / 2
    if groups is None:
        fits = (nl >= max(s.min_rows, 1)) & (n - nl >= max(s.min_rows, 1)) & (n >= s.split_rows) & (hl >= s.min_hessian) & (h - hl >= s.min_hessian)
    else:
        gain = np.stack([gain[groups == k].sum(axis=0) for k in groups])
        fits = np.stack([((nl > 0) & (nl < n))[groups == k].any(axis=0) for k in groups])
    gain = np.where(fits & (gain > s.min_gain), gain, -np.inf).reshape(len(gain), -1)
    found = []
    for i, best in enumerate(gain.argmax(axis=1)):
        band, cut = divmod(int(best), s.bins)
        left = (gl[i, band, cut], hl[i, band, cut], nl[i, band, cut])
        found.append(((g[i, 0, 0], h[i, 0, 0], n[i, 0, 0]), (bands[band], cut, *left) if gain[i, best] > -np.inf else None))
    return found


def _leaf_value(g: float, h: float, s: BoostSettings) -> float:
    return -g / (h + s.leaf_l2) if h + s.leaf_l2 > 1e-12 else 0.0


def _bands_of_round(d: int, s: BoostSettings, round_: int) -> list[int]:
    if s.band_share >= 1:
        return list(range(d))
    rng = np.random.RandomState([s.seed % (1 << 32), round_])
    return sorted(rng.choice(d, max(1, int(round(d * s.band_share))), replace=False).tolist())


def fit_boosted(df: DataFrame, code: Column, d: int, outputs: int, settings: BoostSettings | None = None, **options) -> Boosted:
    """Train on rows of `bands` (and `weight`, if there is one); `code` is the 0-based class.

    A band that is not a number goes right at every split. Rows per level and round are
    read once for all trees; a round needs `depth` jobs.
    """
    s = settings or BoostSettings(**options)
    if s.leaf_l2 < 0 or s.min_gain < 0 or not 0 < s.row_share <= 1 or not 0 < s.band_share <= 1 or s.depth < 1:
        raise ValueError("leaf_l2 and min_gain must not be negative, shares lie in (0, 1], depth is 1 or more")
    edges = bin_edges(df, d, s.bins, s.binning)
    rows = binned_rows(df, code, edges, outputs)
    model, pending = Boosted([], s.rate, outputs), []
    for round_ in range(s.rounds):
        trees, loss = _grow_round(rows, d, outputs, edges, pending, s, round_)
        model.losses.append(loss)
        model.trees.append(trees)
        pending.append(trees)
        if len(pending) == PENDING_ROUNDS:
            rows, pending = _rescored(rows, d, outputs, pending, s.rate), []
    model.losses.append(_Sums.collected(_gradient_sums(rows, d, outputs, pending, [], [], [0], s, 0), 0, [0], s.bins).loss)
    return model


def _grow_round(rows, d, outputs, edges, pending, s: BoostSettings, round_: int) -> tuple[list[Tree], float]:
    trees = [Tree.root(1) for _ in range(outputs)]
    bands, draw = _bands_of_round(d, s, round_), s.seed * 1_000_003 + round_
    frontier, loss = [(k, 0) for k in range(outputs)], 0.0
    for level in range(s.depth):
        at_once = max(1, TASK_CELLS // (3 * len(bands) * s.bins))
        # A symmetric level is decided per class, so the slots of a class stay together.
        parts = [frontier[i : i + at_once] for i in range(0, len(frontier), at_once)]
        if s.symmetric:
            parts = _whole_classes(frontier, at_once)
        grown = []
        for part in parts:
            sums = _gradient_sums(rows, d, outputs, pending, trees, part, bands, s, draw)
            sums = _Sums.collected(sums, len(part), bands, s.bins)
            loss = sums.loss if level == 0 else loss
            groups = np.array([k for k, _ in part]) if s.symmetric else None
            for (k, node), ((g, h, n), best) in zip(part, _best_splits(sums, bands, s, groups)):
                tree = trees[k]
                tree.cover[node], tree.value[node] = n, _leaf_value(g, h, s)
                if best is None:
                    continue
                band, cut, *left = best
                sides = [left, [g - left[0], h - left[1], n - left[2]]]
                made = tree.split(node, band, float(edges[band][cut]), cut, np.array([[_leaf_value(*side[:2], s)] for side in sides]), [side[2] for side in sides])
                grown += [(k, child) for child in made]
        frontier = grown
        if not frontier:
            break
    return trees, loss


def _whole_classes(frontier: Sequence[tuple[int, int]], most: int) -> list[list[tuple[int, int]]]:
    parts: list[list[tuple[int, int]]] = []
    for k in sorted({k for k, _ in frontier}):
        mine = [pair for pair in frontier if pair[0] == k]
        if parts and len(parts[-1]) + len(mine) <= most:
            parts[-1] += mine
        else:
            parts.append(mine)
    return parts
