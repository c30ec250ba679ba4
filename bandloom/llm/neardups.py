"""Near-duplicate texts by exact Jaccard similarity of word shingles.

SimHashes (of the same shingles) within two bits are found by the Gray-order index of
`simhash`. Pairs at
the limit of 0.8 lie up to a dozen bits apart, where shared bits rule out no pair of
groups any more. So further candidates come from MinHash bands: two texts at the
limit miss each other in every band with probability (1 - 0.8^4)^24, about 3 in a
million, and pairs above it less. Every link, by either way, is verified on the
shingle sets.
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
from bandloom.llm.simhash import bit_counts, fingerprint_links, majority
from bandloom.llm.words import SPACES
from bandloom.session import cut_lineage

SHINGLE = 5
JACCARD = 0.8
BANDS = 24
BAND_ROWS = 4
# Texts and shingle hashes of a block; two blocks at most meet in memory at once.
BLOCK_TEXTS = 1024
BLOCK_HASHES = 250_000
# Cells of the table of texts and shingles that are multiplied at once: 16 MB.
_CELLS = 1 << 22

_rng = np.random.RandomState(7)
_FLIP, _TIMES = (_rng.randint(0, 1 << 63, size=(BANDS * BAND_ROWS, 1), dtype=np.int64).astype(np.uint64) for _ in range(2))
_TIMES = _TIMES * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)
# Hashes that are mixed, and whose bits are counted, at once.
_CHUNK = 512
_BITS_AT_ONCE = 1 << 15


def normal_text(text: Column) -> Column:
    """Lower-case words of a text joined by single spaces; empty for null and blank texts."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")))


def shingle_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the 5-word shingles of a normal text, repeats included; a shorter text is one shingle, an empty one none."""
    words = text.encode("utf-8", "surrogatepass").split(b" ") if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
    joined = b" ".join(words)
    ends = (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts = [0, *[e + 1 for e in ends[:-1]]]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends[SHINGLE - 1 :])], dtype=np.uint64)


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct hashes of a normal text."""
    return np.unique(shingle_hashes(text))


def simhash(hashes: np.ndarray) -> int:
    """Signed 64-bit SimHash of the shingle hashes of a text, zero without any."""
    counts = sum((bit_counts(hashes[at : at + _BITS_AT_ONCE]) for at in range(0, len(hashes), _BITS_AT_ONCE)), np.zeros(64, np.int64))
    return int(np.uint64(majority(counts, len(hashes))).view(np.int64))


def band_keys(grams: np.ndarray) -> list[int]:
    """One key per band, equal for texts whose smallest hashes agree in all rows of the band."""
    if not len(grams):
        return []
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    space, high = np.empty((2, BANDS * BAND_ROWS, min(_CHUNK, len(grams))), dtype=np.uint64)
    for at in range(0, len(grams), _CHUNK):
        part = grams[None, at : at + _CHUNK]
        mixed, upper = space[:, : part.shape[1]], high[:, : part.shape[1]]
        np.bitwise_xor(part, _FLIP, out=mixed)
        mixed *= _TIMES
        mixed ^= np.right_shift(mixed, np.uint64(32), out=upper)
        mixed *= _MIX
        least = np.minimum(least, mixed.min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return [int(np.uint64(xxhash.xxh64_intdigest(rows[b].tobytes(), b)).view(np.int64)) for b in range(BANDS)]


def similar(a: np.ndarray, b: np.ndarray, limit: float = JACCARD) -> bool:
    """Whether the Jaccard similarity of two sorted sets is `limit` or more."""
    small, large = sorted((len(a), len(b)))
    if not small or small < limit * large - 1e-9:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= limit * (len(a) + len(b) - both) - 1e-9


@F.pandas_udf(T.StructType([T.StructField("code", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))]))
def _sketch(text: pd.Series) -> pd.DataFrame:
    """SimHash and band keys from one pass over the shingles."""
    codes, bands = [], []
    for t in text:
        hashes = shingle_hashes(t)
        codes.append(simhash(hashes))
        bands.append(band_keys(np.unique(hashes)))
    return pd.DataFrame({"code": np.array(codes, dtype=np.int64), "bands": pd.Series(bands, dtype=object)})


@F.pandas_udf(T.BinaryType())
def _sets(text: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t).tobytes() for t in text])


@F.pandas_udf(T.BooleanType())
def _near(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)], dtype=bool)


def common_counts(left: list[np.ndarray], right: list[np.ndarray] | None = None) -> np.ndarray:
    """How many hashes each sorted set of one list shares with each of the other, or of the same list."""
    sets = [*left, *(right or [])]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    hashes, at = np.unique(np.concatenate(sets), return_inverse=True)
    # Hashes that no pair can share are left out.
    seen = np.bincount(at[row < len(left)], minlength=len(hashes))
    seen = seen > 1 if right is None else (seen > 0) & (seen < np.bincount(at, minlength=len(hashes)))
    row, column = row[seen[at]], (np.cumsum(seen) - 1)[at[seen[at]]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total, step = np.count_nonzero(seen), max(1, _CELLS // len(sets))
    out = np.zeros((len(left), len(left if right is None else right)), dtype=np.int64)
    for start in range(0, total, step):
        part = slice(*np.searchsorted(column, (start, start + step)))
        table = np.zeros((len(sets), min(step, total - start)), dtype=np.float32)
        table[row[part], column[part] - start] = 1
        out += (table[: len(left)] @ (table if right is None else table[len(left) :]).T).astype(np.int64)
    return out


def _group_links(rows: pd.DataFrame) -> list[tuple[int, int]]:
    """Links that join what the similar pairs of a pair of blocks join; texts of one known component are not linked again."""
    sets = np.array([np.frombuffer(g, np.uint64) for g in rows["grams"]] + [None], dtype=object)[:-1]
    node, block = rows["node"].to_numpy(), rows["block"].to_numpy()
    names, known = np.unique(rows["component"].to_numpy(), return_inverse=True)
    lo, hi = (np.flatnonzero(block == rows[side].iloc[0]) for side in ("lo", "hi"))
    if not len(lo) or not len(hi):
        return []
    size = np.array([len(s) for s in sets])
    within = rows["lo"].iloc[0] == rows["hi"].iloc[0]
    shared = common_counts(list(sets[lo]), None if within else list(sets[hi]))
    near = shared >= JACCARD * (size[lo][:, None] + size[hi][None, :] - shared) - 1e-9
    near &= (known[lo][:, None] != known[hi][None, :]) & (shared > 0)
    i, j = np.nonzero(near)
    a, b = known[lo][i], known[hi][j]
    # One pair of texts is enough for a pair of components.
    _, pick = np.unique(np.minimum(a, b) * len(names) + np.maximum(a, b), return_index=True)
    parent = list(range(len(names)))

    def find(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    out = []
    for p in pick.tolist():
        x, y = find(a[p]), find(b[p])
        if x != y:
            parent[x] = y
            out.append((int(node[lo][i[p]]), int(node[hi][j[p]])))
    return out


def _all_links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups lie together in a sorted partition, across batches too."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat((rest, batch), ignore_index=True)
        if not len(rows):
            continue
        mark = rows[["key", "lo", "hi"]].to_numpy()
        edges = [0, *(np.flatnonzero((mark[1:] != mark[:-1]).any(axis=1)) + 1).tolist()]
        found = [link for a, b in zip(edges, edges[1:]) for link in _group_links(rows.iloc[a:b])]
        rest = rows.iloc[edges[-1] :]
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])
    if rest is not None and len(rest) and (found := _group_links(rest)):
        yield pd.DataFrame(found, columns=["a", "b"])


def fingerprint_pairs(nodes: DataFrame, bits: int = 2) -> DataFrame:
    """Rows (a, b) of the nodes of (node, code) whose SimHashes differ in at most `bits` bits.

    Nodes of one code meet at the smallest of them; the index joins different codes.
    """
    codes = cut_lineage(nodes.groupBy("code").agg(F.min("node").alias("least")), "codes")
    same = nodes.join(codes, "code").filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b"))
    return same.unionByName(fingerprint_links(codes.select("code", F.col("least").alias("node")), bits))


def near_links(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows (a, b) that connect the nodes of (node, code, bands) as all similar candidate pairs do.

    `texts` has rows (node, text), those of one node with the same normal text. Pairs
    with close SimHashes and each bucket with its smallest node are compared first. Buckets whose texts are one
    component by that are done; in the others every pair between different
    components is compared, block by block, but none inside the largest component.
    """
    bands = nodes.select("node", F.explode("bands").alias("key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("leader"), F.bit_xor(F.xxhash64("node")).alias("sign")).filter("m > 1")
    # Bands that gather the same texts are compared once.
    buckets = buckets.groupBy("m", "leader", "sign").agg(F.min("key").alias("key")).drop("sign")
    members = cut_lineage(bands.join(buckets, "key").select("key", "leader", "node"), "members")
    close = cut_lineage(fingerprint_pairs(nodes.select("node", "code")), "close")
    ends = close.select(F.explode(F.array("a", "b")).alias("node"))
    involved = cut_lineage(members.select("node").unionByName(ends).distinct(), "involved")
    sets = texts.join(involved, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    sets = sets.select("node", _sets("text").alias("grams")).withColumn("n", (F.octet_length("grams") / 8).cast("bigint"))
    sets = cut_lineage(sets, "sets")

    stars = members.filter("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b")).unionByName(close).distinct()
    stars = stars.join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    stars = stars.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a")
    stars = cut_lineage(stars.filter(_near("x", "y")).select("a", "b"), "stars")

    known = involved.join(components(stars), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    known = known.join(sets.select("node", "n"), "node")
    rows = cut_lineage(members.select("key", "node").join(known, "node"), "known")
    parts = rows.groupBy("key", "component").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
    # Pairs inside the largest component of a bucket need no comparison, so its texts meet only the others.
    most = F.max(F.struct("m", "component", "n"))
    parts = parts.groupBy("key").agg(F.count("*").alias("parts"), F.sum("m").alias("m"), F.sum("n").alias("n"), most.alias("main")).filter("parts > 1")
    blocks = lambda m, n: F.greatest(F.ceil(m / BLOCK_TEXTS), F.ceil(n / BLOCK_HASHES)).cast("int")
    one, main = blocks(F.col("m"), F.col("n")) == 1, F.col("main")
    parts = parts.select(
        "key", main["component"].alias("main"),
        F.when(one, 1).otherwise(blocks(F.col("m") - main["m"], F.col("n") - main["n"])).alias("others"),
        F.when(one, 0).otherwise(blocks(main["m"], main["n"])).alias("cores"))
    rows = rows.join(parts, "key")
    place = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    core = (F.col("cores") > 0) & (F.col("component") == F.col("main"))
    rows = rows.withColumn("block", F.when(core, F.col("others") + place(F.greatest("cores", F.lit(1)))).otherwise(place(F.col("others"))))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(core, F.col("others")).otherwise(F.col("others") + F.col("cores")) - 1)))
    rows = rows.select("key", "node", "component", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    rows = cut_lineage(rows, "blocks")
    mixed = rows.groupBy("key", "lo", "hi").agg(F.min("component").alias("p"), F.max("component").alias("q")).filter("p <> q").select("key", "lo", "hi")
    rows = rows.join(mixed, ["key", "lo", "hi"]).join(sets.drop("n"), "node")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return stars.unionByName(rows.mapInPandas(_all_links, "a bigint, b bigint"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` per group of near duplicates: that of the smallest id.

    Documents are linked when the Jaccard similarity of their lower-cased 5-word
    shingles is 0.8 or more; texts that are equal but for case and white space meet
    as one, also blank ones. Rows without an id stay only in groups without any id,
    one row per group. Of rows that share text and id the one with the lowest digest
    of its columns stays. Columns stay as they are, whatever their names.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), normal_text(F.col(text_col)).alias("text"))
    marked = rows.withColumn("node", F.xxhash64("text"))
    sketches = marked.select("node", "id", _sketch("text").alias("sketch"))
    nodes = sketches.groupBy("node").agg(F.min("id").alias("first"), F.first("sketch").alias("sketch")).select("node", "first", "sketch.*")
    nodes = cut_lineage(nodes, "sketches")
    links = cut_lineage(near_links(nodes, marked.select("node", "text")), "found")
    joined = nodes.drop("code", "bands").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("first").alias("least"), F.min("node").alias("lowest"))
    # Different texts may share the smallest id; then the lowest of their nodes stays.
    named = joined.join(least, "component").filter(F.col("first") == F.col("least")).groupBy("component").agg(F.min("node").alias("node"), F.first("least").alias("id"))
    unnamed = least.filter("least is null").select("component", F.col("lowest").alias("node"), F.col("least").alias("id"))
    chosen = named.unionByName(unnamed).select(F.col("node").alias("chosen"), F.col("id").alias("least"))
    kept = marked.join(chosen, (F.col("node") == F.col("chosen")) & F.col("id").eqNullSafe(F.col("least")), "left_semi")
    # Rows of one text and id may differ elsewhere; a digest of the whole row decides, so that reruns agree.
    kept = kept.groupBy("node").agg(F.min_by("row", F.md5(F.to_json("row"))).alias("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
