"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets.

A vector is turned by fast pseudo-random rotations (three rounds of sign flips and
Hadamard transforms); its hash is the nearest signed axis. A table joins several
such hashes into a bucket, and a vector also enters the buckets that it misses by
least. Vectors that meet in a bucket are compared by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom.llm.components import components
from bandloom.session import cut_lineage

COSINE = 0.98
TABLES = 4
HASHES = 2
PROBES = 3
# A bucket larger than this is compared block against block, in tasks of their own.
BLOCK = 512
SEED = 20


@lru_cache(maxsize=16)
def _signs(size: int, rotations: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed).choice((-1.0, 1.0), size=(rotations, 3, size))


def rotate(x: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Rows of `x` (width a power of two) after three rounds of sign flips and Hadamard transforms."""
    width = x.shape[1]
    for flips in signs:
        x = x * flips
        step = 1
        while step < width:
            pairs = x.reshape(len(x), -1, 2, step)
            x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(len(x), width)
            step *= 2
        x = x / np.sqrt(width)
    return x


def bucket_keys(x: np.ndarray, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED) -> np.ndarray:
    """Buckets of unit vectors, one row each: per table its own bucket, then the `probes` nearest others.

    Another bucket replaces one hash by its next best axis; those with the smallest
    loss of squared length come first.
    """
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    signs = _signs(width, tables * hashes, seed)
    ways = 1 + probes
    out = []
    for t in range(tables):
        axes, losses = [], []
        for k in range(hashes):
            y = rotate(x, signs[t * hashes + k])
            order = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : min(ways, width)]
            best = np.take_along_axis(y, order, axis=1)
            axes.append(order * 2 + (best < 0))
            losses.append(best[:, :1] ** 2 - best**2)
        scale = (2 * width) ** np.arange(hashes, dtype=np.int64)
        own = sum(a[:, 0] * s for a, s in zip(axes, scale))
        changed = np.concatenate([own[:, None] + (a[:, 1:] - a[:, :1]) * s for a, s in zip(axes, scale)], axis=1)
        loss = np.concatenate([e[:, 1:] for e in losses], axis=1)
        near = np.argsort(loss, axis=1, kind="stable")[:, :probes]
        keys = np.concatenate((own[:, None], np.take_along_axis(changed, near, axis=1)), axis=1)
        out.append(keys * tables + t)
    return np.concatenate(out, axis=1)


def _matrix(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), dtype=np.float64)
    return x / np.linalg.norm(x / np.abs(x).max(axis=1, keepdims=True), axis=1, keepdims=True) / np.abs(x).max(axis=1, keepdims=True)


def _hash(tables: int, hashes: int, probes: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(batch["vector"].map(len)):
                keys = bucket_keys(_matrix(part["vector"]), tables, hashes, probes)
                yield pd.DataFrame({"node": part["node"].to_numpy(), "keys": list(keys)})

    return run


def _star(size: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of `size` places the smallest place that the links (i, j) connect it to."""
    least = np.arange(size)
    while True:
        before = least.copy()
        np.minimum.at(least, i, least[j])
        np.minimum.at(least, j, least[i])
        if (before == least).all():
            return least


def _verify(cosine: float):
    def group(rows: pd.DataFrame) -> pd.DataFrame | None:
        first = rows.iloc[0]
        x, block = _matrix(rows["vector"]), rows["block"].to_numpy()
        i, j = np.nonzero(np.triu(x @ x.T >= cosine - 1e-9, 1))
        if first["lo"] != first["hi"]:
            cross = block[i] != block[j]
            i, j = i[cross], j[cross]
        if not len(i):
            return None
        # The product above only preselects; the rule is one dot product per pair.
        raw = np.array(rows["vector"].tolist(), dtype=np.float64)
        lengths = np.sqrt((raw * raw).sum(axis=1))
        keep = np.empty(len(i), dtype=bool)
        keys = np.stack(rows["keys"].to_numpy())
        for at in range(0, len(i), 8192):
            p, q = i[at : at + 8192], j[at : at + 8192]
            near = (raw[p] * raw[q]).sum(axis=1) / (lengths[p] * lengths[q]) >= cosine
            same = keys[p][:, :, None] == keys[q][:, None, :]
            least = np.where(same.any(axis=2), keys[p], np.iinfo(np.int64).max).min(axis=1)
            keep[at : at + 8192] = near & (least == first["key"])
        i, j = i[keep], j[keep]
        if not len(i):
            return None
        n, node = rows["n"].to_numpy(), rows["node"].to_numpy()
        links = np.bincount(i, weights=n[j], minlength=len(n)) + np.bincount(j, weights=n[i], minlength=len(n))
        least = _star(len(n), i, j)
        met = np.unique(np.concatenate((i, j)))
        return pd.DataFrame({"a": node[met], "b": node[least[met]], "links": links[met].astype(np.int64)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Groups lie together in a sorted partition, across batches too."""
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat((rest, batch), ignore_index=True)
            if not len(rows):
                continue
            mark = rows[["label", "size", "key", "lo", "hi"]].to_numpy()
            cuts = np.flatnonzero((mark[1:] != mark[:-1]).any(axis=1)) + 1
            edges = [0, *cuts.tolist()]
            found = [g for a, b in zip(edges, edges[1:]) if b - a > 1 and (g := group(rows.iloc[a:b])) is not None]
            rest = rows.iloc[edges[-1] :]
            if found:
                yield pd.concat(found, ignore_index=True)
        if rest is not None and len(rest) > 1 and (g := group(rest)) is not None:
            yield g

    return run


def vector_links(nodes: DataFrame, cosine: float = COSINE, tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, block: int = BLOCK) -> DataFrame:
    """Rows (a, b, links) from distinct vectors (node, label, vector, n).

    `links` adds up, over a's rows, the copies `n` of vectors linked with a; the
    pairs (a, b) connect what the links connect. Both stay linear in the bucket
    entries although links may not. A pair that shares several buckets counts in the
    smallest of them. A bucket of more than `block` vectors is split by node into
    blocks that meet pairwise, each pair of blocks a group of its own.
    """
    hashed = nodes.select("node", "vector").mapInPandas(_hash(tables, hashes, probes), "node bigint, keys array<bigint>")
    hashed = cut_lineage(hashed.join(nodes.select("node", "label", F.size("vector").alias("size")), "node"), "buckets")
    entries = hashed.select("node", "label", "size", F.explode(F.array_distinct("keys")).alias("key"))
    counts = entries.groupBy("label", "size", "key").agg(F.count("*").alias("members")).filter("members > 1")
    counts = counts.select("label", "size", "key", F.ceil(F.col("members") / block).cast("int").alias("blocks"))
    shared = entries.join(counts, ["label", "size", "key"])
    shared = shared.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    shared = shared.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    shared = shared.select("node", "key", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    full = nodes.join(hashed.select("node", "keys", "size"), "node")
    group = ["label", "size", "key", "lo", "hi"]
    rows = shared.join(full, "node").select(*group, "block", "node", "n", "keys", "vector")
    rows = rows.repartition(*group).sortWithinPartitions(*group)
    return rows.mapInPandas(_verify(cosine), "a bigint, b bigint, links bigint")


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = COSINE,
    tables: int = TABLES,
    hashes: int = HASHES,
    probes: int = PROBES,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors are compared when their labels are equal and not null and their lengths
    agree. A null or all-zero vector, or one with null or non-finite components,
    links with nothing. Equal vectors of a label are hashed once and count as copies.
    A row without links is its own component; the component is the smallest id
    reachable (null ids never name one unless they are alone), and `kept` says that
    the row has that id. Rows that repeat an id are linked by their vectors like any
    other. An empty table gives no rows; other columns are ignored. Every reported
    link is verified; hashing misses a share of them (see the recall test).
    """
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = rows.filter("usable").groupBy("label", "vector").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    # Ids may repeat over different vectors, so a node is named by its vector.
    classes = classes.withColumn("node", F.xxhash64("label", "vector"))
    classes = cut_lineage(classes, "vectors")
    found = cut_lineage(vector_links(classes.select("node", "label", "vector", "n"), cosine, tables, hashes, probes), "found")
    degree = found.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = components(found.select("a", "b"))
    named = classes.select("node", "label", "vector", "first", "n").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").join(degree, "node", "left")
    named = named.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    linked = rows.filter("usable").join(named, ["label", "vector"]).select("id", "n_links", "component_id")
    alone = rows.filter("not usable").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept")
    )
