"""Extremely randomised trees: one random threshold per (tree, node, band).

All trees grow a level at a time. A first job finds the range of the candidate bands in
every node; thresholds are drawn there from a seeded digest, so they do not depend on
the layout of the table. A second job sums class weights on both sides of every
threshold and keeps the best per node. Tasks add up their rows first, so what is
shuffled grows with the model and not with the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandloom.functions.matrix import matrix
from bandloom.operators.trees import LEAF, Tree
from bandloom.session import cut_lineage

# Sums a task holds; the nodes of a wide level are taken in several jobs.
TASK_CELLS = 4_000_000


def uniform(seed: int, tree: int, node: int, band: int, kind: str = "cut") -> float:
    """A number in [0, 1) from the MD5 of `seed|kind|tree|node|band` (13 hexadecimal digits)."""
    return int(hashlib.md5(f"{seed}|{kind}|{tree}|{node}|{band}".encode()).hexdigest()[:13], 16) / 16**13


def candidate_bands(d: int, wanted, seed: int, tree: int, node: int) -> list[int]:
    """The bands a node may split: all (None), `sqrt`, `log2`, a number or a share of them, in seeded order."""
    if wanted is None or wanted == "all":
        return list(range(d))
    if wanted == "sqrt":
        m = int(np.sqrt(d))
    elif wanted == "log2":
        m = int(np.log2(d))
    else:
        m = int(wanted) if float(wanted) >= 1 else int(float(wanted) * d)
    m = min(max(m, 1), d)
    return sorted(sorted(range(d), key=lambda b: (uniform(seed, tree, node, b, "band"), b))[:m])


def _each_batch(batches, shared, d: int):
    """(bands, batch, slot per row) for every tree with open nodes; slot -1 is none."""
    trees, slots = shared[:2]
    places: dict[int, np.ndarray] = {}
    for i, (t, node) in enumerate(slots):
        places.setdefault(t, np.full(len(trees[t].band), -1))[node] = i
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch, d)
            for t, at in places.items():
                yield x, batch, at[trees[t].leaf(x)]


def _ranges(rows: DataFrame, d: int, trees: Sequence[Tree], slots: Sequence[tuple[int, int]], bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest finite value of each slot's candidate bands, as (slots, candidates) arrays."""
    shared = rows.sparkSession.sparkContext.broadcast((list(trees), list(slots), bands))
    size, m = bands.shape

    def run(batches):
        low, high = np.full((size, m), np.inf), np.full((size, m), -np.inf)
        for x, _, slot in _each_batch(batches, shared.value, d):
            here = np.flatnonzero(slot >= 0)
            slot = slot[here]
            seen = x[here[:, None], shared.value[2][slot]]
            np.minimum.at(low, slot, np.where(np.isfinite(seen), seen, np.inf))
            np.maximum.at(high, slot, np.where(np.isfinite(seen), seen, -np.inf))
        slot, j = np.nonzero(low <= high)
        yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(low[slot, j]), pa.array(high[slot, j])], names=["slot", "j", "low", "high"])

    found = rows.select("bands").mapInArrow(run, "slot int, j int, low double, high double").groupBy("slot", "j").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    low, high = np.full((size, m), np.nan), np.full((size, m), np.nan)
    for r in found.collect():
        low[r["slot"], r["j"]], high[r["slot"], r["j"]] = r["low"], r["high"]
    return low, high


def _best(rows: DataFrame, d: int, outputs: int, trees, slots, bands: np.ndarray, cuts: np.ndarray, min_leaf: int) -> dict[int, dict]:
    """Per slot the class weights, and of the split with the least Gini impurity its place and left side."""
    shared = rows.sparkSession.sparkContext.broadcast((list(trees), list(slots), bands, cuts))
    size, m = bands.shape

    def run(batches):
        cells = np.zeros((4, size * m * outputs))
        for x, batch, slot in _each_batch(batches, shared.value, d):
            bands, cuts = shared.value[2:]
            here = np.flatnonzero(slot >= 0)
            slot, code, weight = slot[here], batch["code"].to_numpy()[here], batch["weight"].to_numpy()[here]
            less = (x[here[:, None], bands[slot]] <= cuts[slot]).ravel()
            place = ((slot[:, None] * m + np.arange(m)) * outputs + code[:, None]).ravel()
            weight = np.repeat(weight, m)
            length = cells.shape[1]
            cells[0] += np.bincount(place, weight, length)
            cells[1] += np.bincount(place, weight * less, length)
            cells[2] += np.bincount(place, minlength=length)
            cells[3] += np.bincount(place[less], minlength=length)
        met = np.flatnonzero(cells[2])
        slot, rest = np.divmod(met, m * outputs)
        j, code = np.divmod(rest, outputs)
        columns = [slot.astype(np.int32), j.astype(np.int32), code.astype(np.int32), *cells[:2, met], *cells[2:, met].astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slot", "j", "code", "w", "wl", "n", "nl"])

    sums = rows.mapInArrow(run, "slot int, j int, code int, w double, wl double, n bigint, nl bigint")
    sums = sums.groupBy("slot", "j", "code").agg(*[F.sum(c).alias(c) for c in ("w", "wl", "n", "nl")])
    wr = F.col("w") - F.col("wl")
    per_cut = sums.groupBy("slot", "j").agg(
        F.sum("n").alias("n"), F.sum("nl").alias("nl"), F.count(F.when(F.col("w") > 0, 1)).alias("kinds"),
        (F.try_divide(F.sum(F.col("wl") * F.col("wl")), F.sum("wl")) + F.try_divide(F.sum(wr * wr), F.sum(wr))).alias("purity"),
        F.collect_list(F.struct("code", "w", "wl")).alias("classes"))
    fits = (F.col("nl") >= min_leaf) & (F.col("n") - F.col("nl") >= min_leaf) & F.col("purity").isNotNull() & (F.col("kinds") > 1)
    best = F.max(F.when(fits, F.struct("purity", (-F.col("j")).alias("j"), "nl", "classes")))
    found = per_cut.groupBy("slot").agg(F.max("n").alias("n"), F.max_by("classes", -F.col("j")).alias("classes"), best.alias("best"))
    return {r["slot"]: r.asDict(True) for r in found.collect()}


def _shares(weights: np.ndarray) -> np.ndarray:
    total = weights.sum()
    return weights / total if total > 0 else np.full(len(weights), 1 / len(weights))


def fit_extra_trees(
    df: DataFrame, code: Column, d: int, outputs: int, trees: int = 100, depth: int = 10, max_features="sqrt", min_leaf: int = 1, min_split: int = 2, seed: int = 0
) -> list[Tree]:
    """Trees with class shares at their nodes, grown on all rows of `bands` (and `weight`, if there is one).

    A band that is not a number goes right. A node is a leaf at `depth`, when it has
    one class, fewer than `min_split` rows, or no threshold that leaves `min_leaf` rows on
    both sides. Of equal thresholds the smaller band wins.
    """
    weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
    # Read twice a level; written once, so that neither a cache nor the plan behind it is needed.
    rows = cut_lineage(df.select("bands", code.cast("int").alias("code"), weight.alias("weight")), "rows")
    grown = [Tree.root(outputs) for _ in range(trees)]
    frontier = [(t, 0) for t in range(trees)]
    width = len(candidate_bands(d, max_features, seed, 0, 0))
    at_once = max(1, TASK_CELLS // (4 * width * outputs))
    for _ in range(max(depth, 1)):
        children: list[tuple[int, int]] = []
        for start in range(0, len(frontier), at_once):
            slots = frontier[start : start + at_once]
            bands = np.array([candidate_bands(d, max_features, seed, t, node) for t, node in slots])
            low, high = _ranges(rows, d, grown, slots, bands)
            draws = np.array([[uniform(seed, t, node, int(b)) for b in own] for (t, node), own in zip(slots, bands)])
            cuts = low + draws * (high - low)
            found = _best(rows, d, outputs, grown, slots, bands, cuts, min_leaf)
            for i, (t, node) in enumerate(slots):
                if i in found:
                    splits = depth > 0 and found[i]["n"] >= min_split
                    children += [(t, child) for child in _grow(grown[t], node, found[i], bands[i], cuts[i], outputs, splits)]
        frontier = children
        if not frontier:
            break
    return grown


def _grow(tree: Tree, node: int, r: dict, bands: np.ndarray, cuts: np.ndarray, outputs: int, splits: bool) -> list[int]:
    """Fill in a node and split it, if it can be; its children that hold several classes."""
    whole, left = np.zeros(outputs), np.zeros(outputs)
    for c in r["classes"]:
        whole[c["code"]] = c["w"]
    tree.value[node], tree.cover[node] = _shares(whole), whole.sum()
    best = r["best"]
    if best is None or not splits:
        return []
    for c in best["classes"]:
        left[c["code"]] = c["wl"]
    right, j = whole - left, -best["j"]
    made = tree.split(node, int(bands[j]), float(cuts[j]), LEAF, np.array([_shares(left), _shares(right)]), [left.sum(), right.sum()])
    return [child for child, side in zip(made, (left, right)) if (side > 0).sum() > 1]
