"""SimHash near duplicates through a Gray-order hierarchical index.

Fingerprints are sorted by their rank in Gray order, so that neighbours in the
order share most bits. Runs of sorted fingerprints are leaves, runs of leaves are
branches, and the branches of one sorted partition hang below a root. A node keeps
the bits that all fingerprints below it share (mask and pattern, held as the AND
and the OR of the codes). Two nodes whose shared patterns differ in more bits than
allowed hold no link, so the whole pair of groups is dropped; what is left is
opened one level further, down to the codes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bandloom.llm.components import components
from bandloom.session import cut_lineage

LEAF = 512
TWIG = 32
LEAVES_PER_BRANCH = 16
# Roots are compared in memory of every task: 4096 roots of 24 bytes at most.
MAX_ROOTS = 4096
ROOT_CODES = 16_384

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 1 << 15


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each of the 64 bits."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts: np.ndarray, n: int) -> int:
    """The code whose bits are those that over half of `n` hashes have."""
    return int(np.packbits((2 * counts > n).astype(np.uint8), bitorder="little").view("<u8")[0])


def text_fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text, unsigned.

    A-Z is lowered, words are runs without white space (space and controls 9-13),
    shingles keep their repeats. A text with fewer words is one shingle, a text
    without words is zero. A bit is set if more than half of the hashes have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, last, _BLOCK):
        to = min(at + _BLOCK, last)
        spans = zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist())
        counts += bit_counts(np.array([digest(joined[a:b], 42) for a, b in spans], dtype="<u8"))
    return majority(counts, last)


@F.pandas_udf(T.LongType())
def fingerprint(text: pd.Series) -> pd.Series:
    values = np.fromiter((text_fingerprint(t) for t in text), dtype=np.uint64, count=len(text))
    return pd.Series(values.view(np.int64))


def gray_rank(code: Column) -> Column:
    """Place of a code in Gray order, shifted so that signed order is the order of ranks."""
    for step in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, step))
    return code.bitwiseXOR(F.lit(-(1 << 63)))


def _least_difference(a: str, b: str) -> Column:
    """Bits in which all codes below node `a` differ from all codes below node `b`."""
    low_a, high_a, low_b, high_b = (F.col(c) for c in (f"{a}low", f"{a}high", f"{b}low", f"{b}high"))
    fixed = F.bitwise_not(low_a.bitwiseXOR(high_a)).bitwiseAND(F.bitwise_not(low_b.bitwiseXOR(high_b)))
    return F.bit_count(low_a.bitwiseXOR(low_b).bitwiseAND(fixed))


def _leaves(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cut a sorted partition into runs of LEAF codes."""
    held: list[pd.DataFrame] = []
    size, n = 0, 0

    def cut(rows: pd.DataFrame, n: int) -> pd.DataFrame:
        codes = rows["code"].to_numpy(np.int64)
        return pd.DataFrame({
            "root": [int(rows["root"].iloc[0])],
            "n": [n],
            "low": [int(np.bitwise_and.reduce(codes))],
            "high": [int(np.bitwise_or.reduce(codes))],
            "codes": [codes.tobytes()],
            "nodes": [rows["node"].to_numpy(np.int64).tobytes()],
        })

    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < LEAF:
            continue
        rows = pd.concat(held, ignore_index=True)
        full = len(rows) // LEAF * LEAF
        out = []
        for at in range(0, full, LEAF):
            out.append(cut(rows.iloc[at : at + LEAF], n))
            n += 1
        held, size = [rows.iloc[full:]], len(rows) - full
        yield pd.concat(out, ignore_index=True)
    rest = pd.concat(held, ignore_index=True) if held else pd.DataFrame()
    if len(rest):
        yield cut(rest, n)


def _twigs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(0, len(codes), TWIG)
    return np.bitwise_and.reduceat(codes, at), np.bitwise_or.reduceat(codes, at)


def leaf_links(a: np.ndarray, b: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the codes (unsigned) of two sorted leaves that differ in at most `bits` bits."""
    (low_a, high_a), (low_b, high_b) = _twigs(a), _twigs(b)
    fixed = ~(low_a ^ high_a)[:, None] & ~(low_b ^ high_b)[None, :]
    left, right = np.nonzero(np.bitwise_count((low_a[:, None] ^ low_b[None, :]) & fixed) <= bits)
    if not len(left):
        return left, right
    step = np.arange(TWIG)
    rows, columns = left[:, None] * TWIG + step, right[:, None] * TWIG + step
    near = np.bitwise_count(a[np.minimum(rows, len(a) - 1)][:, :, None] ^ b[np.minimum(columns, len(b) - 1)][:, None, :]) <= bits
    near &= (rows < len(a))[:, :, None] & (columns < len(b))[:, None, :]
    pair, i, j = np.nonzero(near)
    return rows[pair, i], columns[pair, j]


def _spanning(i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes as the links (x[i], y[j]), one per linked node at most."""
    least_x, least_y = x.copy(), y.copy()
    while True:
        before_x, before_y = least_x.copy(), least_y.copy()
        np.minimum.at(least_y, j, least_x[i])
        np.minimum.at(least_x, i, least_y[j])
        if (before_x == least_x).all() and (before_y == least_y).all():
            break
    u, v = np.unique(i), np.unique(j)
    return np.concatenate((x[u], y[v])), np.concatenate((least_x[u], least_y[v]))


def _near_roots(shared, bits: int):
    """Branches with each root from their own on that may hold a link; the roots are few by bound."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, low, high = shared.value.T
        for batch in batches:
            a, b = batch["a_low"].to_numpy(np.int64)[:, None], batch["a_high"].to_numpy(np.int64)[:, None]
            differ = ((a ^ low) & ~(a ^ b) & ~(low ^ high)).view(np.uint64)
            i, j = np.nonzero((np.bitwise_count(differ) <= bits) & (root >= batch["root"].to_numpy()[:, None]))
            yield batch[["a", "a_low", "a_high"]].iloc[i].assign(to_root=root[j].astype(np.int32))

    return run


def _compare(bits: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for codes, nodes, codes_b, nodes_b in zip(batch["codes"], batch["nodes"], batch["codes_b"], batch["nodes_b"]):
                i, j = leaf_links(np.frombuffer(codes, np.uint64), np.frombuffer(codes_b, np.uint64), bits)
                if len(i):
                    p, q = _spanning(i, j, np.frombuffer(nodes, np.int64), np.frombuffer(nodes_b, np.int64))
                    found.append(pd.DataFrame({"a": p, "b": q})[p != q])
            if found:
                yield pd.concat(found, ignore_index=True)

    return run


def fingerprint_links(codes: DataFrame, bits: int = 2) -> DataFrame:
    """Rows (a, b) that connect the nodes of (code, node) exactly as all pairs within `bits` bits do.

    `codes` holds different codes. Links inside a pair of leaves are thinned to a
    spanning forest, which keeps every component.
    """
    spark = codes.sparkSession
    count = codes.count()
    roots = max(1, min(MAX_ROOTS, -(-count // ROOT_CODES)))
    ranked = codes.withColumn("rank", gray_rank(F.col("code")))
    ranked = ranked.repartitionByRange(roots, "rank").sortWithinPartitions("rank")
    ranked = ranked.select(F.spark_partition_id().alias("root"), "code", "node")
    leaves = ranked.mapInPandas(_leaves, "root int, n int, low bigint, high bigint, codes binary, nodes binary")
    leaves = leaves.withColumn("branch", F.floor(F.col("n") / LEAVES_PER_BRANCH).cast("int"))
    leaves = leaves.withColumn("leaf", F.shiftleft(F.col("root").cast("bigint"), 32) + F.col("n"))
    leaves = leaves.withColumn("branch", F.shiftleft(F.col("root").cast("bigint"), 32) + F.col("branch"))
    leaves = cut_lineage(leaves, "leaves")

    below = [F.bit_and("low").alias("low"), F.bit_or("high").alias("high")]
    branches = leaves.groupBy("root", "branch").agg(*below)
    tops = leaves.groupBy("root").agg(*below).orderBy("root").collect()
    if len(tops) > max(MAX_ROOTS, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))):
        raise ValueError("more roots than asked for")
    shared = spark.sparkContext.broadcast(np.array([(r.root, r.low, r.high) for r in tops], dtype=np.int64).reshape(-1, 3))
    met = branches.select("root", F.col("branch").alias("a"), F.col("low").alias("a_low"), F.col("high").alias("a_high"))
    met = met.mapInPandas(_near_roots(shared, bits), "a bigint, a_low bigint, a_high bigint, to_root int")
    b = branches.select(F.col("root").alias("to_root"), F.col("branch").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    pairs = met.join(b, "to_root").filter("b >= a").filter(_least_difference("a_", "b_") <= bits)
    pairs = pairs.select("a", "b", "b_low", "b_high")

    small = leaves.select("branch", "leaf", "low", "high")
    la = small.select(F.col("branch").alias("a"), F.col("leaf").alias("leaf_a"), F.col("low").alias("x_low"), F.col("high").alias("x_high"))
    lb = small.select(F.col("branch").alias("b"), F.col("leaf").alias("leaf_b"), F.col("low").alias("y_low"), F.col("high").alias("y_high"))
    opened = pairs.join(la, "a").filter(_least_difference("x_", "b_") <= bits).select("b", "leaf_a", "x_low", "x_high")
    opened = opened.join(lb, "b").filter("leaf_b >= leaf_a").filter(_least_difference("x_", "y_") <= bits).select("leaf_a", "leaf_b")

    own = leaves.select(F.col("leaf").alias("leaf_a"), "codes", "nodes")
    other = leaves.select(F.col("leaf").alias("leaf_b"), F.col("codes").alias("codes_b"), F.col("nodes").alias("nodes_b"))
    matched = opened.join(own, "leaf_a").join(other, "leaf_b").select("codes", "nodes", "codes_b", "nodes_b")
    return matched.mapInPandas(_compare(bits), "a bigint, b bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 2) -> DataFrame:
    """One row per document: id, fingerprint (16 hexadecimal digits) and component.

    Documents are linked when their fingerprints differ in at most `bits` bits; the
    component is the smallest id reachable. Equal texts meet once, by fingerprint.
    Null and blank texts have fingerprint zero and are linked like any other. A null
    id is returned and never names a component unless no document of it has an id;
    repeated ids are repeated rows. An empty table gives no rows. Other columns are
    left out, whatever their names.
    """
    marked = docs.select(F.col(id_col).cast("bigint").alias("id"), fingerprint(F.col(text_col)).alias("code"))
    marked = cut_lineage(marked, "fingerprints")
    # A code is its own node, so codes that only unnamed documents have stay apart.
    codes = marked.groupBy("code").agg(F.min("id").alias("first"))
    codes = cut_lineage(codes.select("code", F.col("code").alias("node"), "first"), "codes")
    found = components(fingerprint_links(codes.select("code", "node"), bits))
    joined = codes.join(found, "node", "left").select("code", "first", F.coalesce("component", "node").alias("component"))
    joined = cut_lineage(joined, "joined")
    least = joined.groupBy("component").agg(F.min("first").alias("least"))
    named = joined.join(least, "component").select("code", "least")
    out = marked.join(named, "code")
    return out.select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"),
        F.col("least").alias("component_id"),
    )
