"""Decision trees as plain arrays: prediction, and exact attribution along their paths."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.functions.matrix import field, map_matrix

LEAF = -1
# Cells (rows x leaves x bands of a path) worked on at a time.
_PATH_CELLS = 4_000_000


@dataclass
class Tree:
    """Nodes in order of growth. A row goes left where its band is at most the threshold.

    `band` is LEAF at leaves; `cut` is the threshold as a bin number for trees grown on
    bins; `value` has one number per output at every node, `cover` the weight of the
    training rows there.
    """

    band: np.ndarray
    threshold: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def root(cls, outputs: int) -> Tree:
        one = lambda v: np.array([v])
        return cls(one(LEAF), one(0.0), one(LEAF), one(LEAF), one(LEAF), np.zeros((1, outputs)), one(0.0))

    def split(self, node: int, band: int, threshold: float, cut: int, values: np.ndarray, covers: Sequence[float]) -> tuple[int, int]:
        """Give `node` two children; their numbers."""
        n = len(self.band)
        self.band[node], self.threshold[node], self.cut[node] = band, threshold, cut
        self.left[node], self.right[node] = n, n + 1
        pair = np.array([LEAF, LEAF])
        self.band, self.cut = np.append(self.band, pair), np.append(self.cut, pair)
        self.left, self.right = np.append(self.left, pair), np.append(self.right, pair)
        self.threshold = np.append(self.threshold, [0.0, 0.0])
        self.value = np.vstack((self.value, values))
        self.cover = np.append(self.cover, covers)
        return n, n + 1

    def _walk(self, x: np.ndarray, bound: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))
        while True:
            band = self.band[node]
            inner = band >= 0
            if not inner.any():
                return node
            less = x[rows, np.maximum(band, 0)] <= bound[node]
            node = np.where(inner, np.where(less, self.left[node], self.right[node]), node)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row of bands."""
        return self._walk(x, self.threshold)

    def leaf_of_bins(self, bins: np.ndarray) -> np.ndarray:
        """Leaf of every row of bin numbers."""
        return self._walk(bins, self.cut)


def tree_rows(trees: Sequence[Tree]) -> list[tuple]:
    """Rows (tree, node, band, threshold, left, right, value, cover)."""
    return [
        (t, i, int(tree.band[i]), float(tree.threshold[i]), int(tree.left[i]), int(tree.right[i]), tree.value[i].tolist(), float(tree.cover[i]))
        for t, tree in enumerate(trees)
        for i in range(len(tree.band))
    ]


TREE_TABLE = "tree int, node int, band int, threshold double, left int, right int, value array<double>, cover double"


def trees_of_rows(rows: Sequence) -> list[Tree]:
    """Trees from rows of TREE_TABLE in any order."""
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r["tree"], []).append(r)
    trees = []
    for number in sorted(found):
        nodes = sorted(found[number], key=lambda r: r["node"])
        column = lambda name, kind, nodes=nodes: np.array([r[name] for r in nodes], dtype=kind)
        trees.append(Tree(column("band", int), column("threshold", float), np.full(len(nodes), LEAF), column("left", int), column("right", int),
                          np.array([list(r["value"]) for r in nodes], dtype=float), column("cover", float)))
    return trees


def forest_trees(spark: SparkSession, model) -> list[Tree]:
    """The trees of a fitted Spark forest, values as class shares, read from its saved form."""
    from bandloom.session import scratch_path

    path = scratch_path(spark, "forest")
    model.write().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        F.col("treeID").alias("tree"), F.col("nodeData.id").alias("node"), F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"), F.col("nodeData.leftChild").alias("left"),
        F.col("nodeData.rightChild").alias("right"), F.col("nodeData.impurityStats").alias("stats"))
    # As many rows as the model has nodes.
    rows = []
    for r in nodes.collect():
        total = sum(r["stats"]) or 1.0
        inner = r["left"] >= 0
        rows.append({"tree": r["tree"], "node": r["node"], "band": r["feature"] if inner else LEAF, "threshold": r["threshold"] if inner else 0.0,
                     "left": r["left"], "right": r["right"], "value": [v / total for v in r["stats"]], "cover": float(sum(r["stats"]))})
    return trees_of_rows(rows)


@dataclass
class Paths:
    """All leaves of some trees as boxes: per leaf the bands of its path, their bounds and the share of
    training rows that the splits on each band let through. Unused places have share 1 and no bounds."""

    band: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray


def leaf_paths(trees: Sequence[Tree], scale: float = 1.0) -> Paths:
    """The leaf table of `trees`, values times `scale`. Leaves that no training row reaches are left out."""
    found = []
    for tree in trees:
        stack = [(0, {})]
        while stack:
            node, path = stack.pop()
            if tree.band[node] < 0:
                found.append((path, tree.value[node] * scale))
                continue
            band = int(tree.band[node])
            low, high, share = path.get(band, (-np.inf, np.inf, 1.0))
            limit = tree.threshold[node]
            for child, bounds in ((tree.left[node], (low, min(high, limit))), (tree.right[node], (max(low, limit), high))):
                if tree.cover[child] > 0:
                    stack.append((int(child), {**path, band: (*bounds, share * tree.cover[child] / tree.cover[node])}))
    width = max((len(path) for path, _ in found), default=0)
    shape = (len(found), width)
    paths = Paths(np.zeros(shape, dtype=int), np.full(shape, -np.inf), np.full(shape, np.inf), np.ones(shape), np.array([v for _, v in found]))
    for i, (path, _) in enumerate(found):
        for j, (band, (low, high, share)) in enumerate(sorted(path.items())):
            paths.band[i, j], paths.low[i, j], paths.high[i, j], paths.share[i, j] = band, low, high, share
    return paths


def path_attributions(paths: Paths, x: np.ndarray) -> np.ndarray:
    """(rows, outputs, bands): exact Shapley values where a band outside a coalition takes both sides of its
    splits, in the shares of the training rows.

    The worth of a leaf is a product over the bands of its path, so the value of band b is the leaf's
    number times (inside - share) times the integral over [0, 1] of the product of share * (1 - t) + inside * t
    of the other bands. The integrand is a polynomial of a degree below the length of the path, for which
    the Gauss-Legendre rule of half as many points is exact. Work is linear in the leaves.
    """
    n, d = x.shape
    leaves, width = paths.band.shape
    out = np.zeros((n, paths.value.shape[1] if leaves else 0, d))
    if not width:
        return out
    points, weights = np.polynomial.legendre.leggauss(width // 2 + 1)
    points, weights = (points + 1) / 2, weights / 2
    step = max(1, _PATH_CELLS // (leaves * width))
    for start in range(0, n, step):
        rows = x[start : start + step]
        seen = rows[:, paths.band]
        # A band that is not a number fails every split, so it stays on the side without upper bound.
        inside = np.where(np.isnan(seen), np.isinf(paths.high), (seen > paths.low) & (seen <= paths.high)).astype(float)
        total = np.zeros_like(inside)
        for t, w in zip(points, weights):
            factor = paths.share * (1 - t) + inside * t
            total += w * np.prod(factor, axis=2, keepdims=True) / factor
        gain = (inside - paths.share) * total
        for j in range(width):
            shares = gain[:, :, j, None] * paths.value[None, :, :]
            by_band = np.zeros((d, len(rows), paths.value.shape[1]))
            np.add.at(by_band, paths.band[:, j], shares.transpose(1, 0, 2))
            out[start : start + step] += by_band.transpose(1, 2, 0)
    return out


def attributed(df: DataFrame, paths: Paths, d: int, outputs: int) -> DataFrame:
    """(sample_id, values) of every row, in one pass without a shuffle; the values of a class lie together, by band."""
    shared = df.sparkSession.sparkContext.broadcast(paths)

    def compute(x, _):
        return [path_attributions(shared.value, x).reshape(len(x), outputs * d)]

    return map_matrix(df, d, ["sample_id"], [field("values", "array<double>")], compute)


def attribute(df: DataFrame, paths: Paths, d: int, classes: Sequence[int]) -> DataFrame:
    """(sample_id, class, band, value) of every row, in one pass without a shuffle."""
    made = attributed(df, paths, d, len(classes))
    codes = F.array(*[F.lit(int(c)) for c in classes])
    long = made.select("sample_id", F.posexplode("values").alias("at", "value"))
    return long.select("sample_id", F.get(codes, F.floor(F.col("at") / d).cast("int")).alias("class"), (F.col("at") % d + 1).cast("int").alias("band"), "value")
