"""Synthetic minority samples between nearest neighbours (Chawla et al. 2002)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bandloom import fixed_values as fv
from bandloom.functions import ordering as od
from bandloom.operators.balance import count_map
from bandloom.operators.neighbors import knn_join
from bandloom.operators.prepare import band_count

# Synthetic samples made from one seed within one task.
COPIES_PER_TASK = 10_000
# Columns of a seed that its synthetic samples keep.
BELONGS = ("polygon_id", "stand_id", "x", "y")


def neighbors_used(counts: dict, k: int) -> int:
    """k, lowered when the smallest class is too small for it."""
    smallest = min(counts.values())
    return max(1, smallest - 1) if smallest <= k else k


STRATEGIES = ("auto", "not majority", "minority", "not minority", "all")


def class_targets(counts: Mapping[int, int], strategy: str | Mapping[int, int] = "auto") -> dict[int, int]:
    """Rows every class shall have.

    Named strategies raise classes to the size of the largest: all of them (`auto`,
    `not majority`, `all`), only the smallest (`minority`; the smallest code wins ties) or
    all but the smallest (`not minority`). A mapping gives the rows of the classes it names.
    """
    if isinstance(strategy, str):
        if strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {strategy!r}; known are {', '.join(STRATEGIES)}")
        most, least = max(counts.values()), min(counts, key=lambda c: (counts[c], c))
        raised = {"minority": {least}, "not minority": set(counts) - {least}}.get(strategy, set(counts))
        return {c: most if c in raised else n for c, n in counts.items()}
    if unknown := sorted(set(strategy) - set(counts)):
        raise ValueError(f"no samples of class {', '.join(map(str, unknown))}")
    if fewer := sorted(c for c, n in strategy.items() if n < counts[c]):
        raise ValueError(f"oversampling cannot leave fewer rows than there are: class {', '.join(map(str, fewer))}")
    return {c: int(strategy.get(c, n)) for c, n in counts.items()}


def synthetic_samples(df: DataFrame, k: int = fv.SMOTE_NEIGHBORS, seed: int = 0, strategy: str | Mapping[int, int] = "auto") -> DataFrame:
    """(sample_id, label, bands, and what else a seed has) raising every class to its target.

    Each sample of a minority class seeds its equal share of the missing rows;
    the remainder falls on the first samples in seeded order. A new row lies
    between its seed and one of the seed's k nearest samples of the class. It
    keeps the seed's polygon, stand and position, so that it stays on the seed's
    side of every split by place.
    """
    belongs = [c for c in BELONGS if c in df.columns]
    counts = count_map(df)
    targets = class_targets(counts, strategy)
    k = neighbors_used(counts, k)
    d = band_count(df)
    parts = None
    for label, n in sorted(counts.items()):
        need = targets[label] - n
        if need == 0:
            continue
        if n < 2:
            raise ValueError(f"class {label} has one sample; a neighbour is needed to interpolate")
        mine = df.filter(F.col("label") == label).select("sample_id", "label", "bands", *belongs)
        share, rest = divmod(need, n)
        cuts = od.hash_cuts(mine, "label", {label: rest}, "sample_id", seed)
        marked = od.below_cut(mine, "label", cuts, "sample_id", seed, "_more")
        seeds = marked.withColumn("_copies", F.lit(share) + F.when(F.col("_more"), 1).otherwise(0)).filter("_copies > 0")
        plain = mine.select("sample_id", "label", "bands")
        # Only samples that seed something need neighbours.
        found = knn_join(seeds.select("sample_id", "bands"), plain, k + 1, d)
        others = F.slice(F.filter("neighbors", lambda e: e["ref_id"] != F.col("sample_id")), F.lit(1), F.lit(k))
        # The vectors of the neighbours travel with the seed, so that nothing has to be
        # joined once a seed has become many rows.
        links = found.select("sample_id", F.posexplode(F.transform(others, lambda e: e["ref_id"])).alias("_at", "_other"))
        # Spark takes the lists for shorter than they are, so neither side is broadcast.
        ends = mine.select(F.col("sample_id").alias("_other"), F.col("bands").alias("_end"))
        near = links.join(ends.hint("merge"), "_other").groupBy("sample_id").agg(
            F.transform(F.sort_array(F.collect_list(F.struct("_at", "_end"))), lambda e: e["_end"]).alias("_ends"))
        made = spread_copies(seeds.select("sample_id", "label", "bands", *belongs, "_copies").join(near.hint("merge"), "sample_id"), share + 1)
        hashed = od.seeded_hash(seed, "sample_id", "_copy")
        chosen = made.select(
            "sample_id", "label", "bands", *belongs, "_copy", od.hash_unit(F.md5(hashed)).alias("_u"),
            F.get("_ends", (od.hash_uint(hashed, 6) % F.size("_ends")).cast("int")).alias("_end"))
        between = F.zip_with("bands", "_end", lambda a, b: a + F.col("_u") * (b - a))
        out = chosen.select(
            F.concat_ws("#", F.col("sample_id").cast("string"), F.col("_copy").cast("string")).alias("sample_id"), "label",
            between.alias("bands"), *belongs)
        parts = out if parts is None else parts.unionByName(out)
    return parts if parts is not None else df.select(F.col("sample_id").cast("string"), "label", "bands", *belongs).limit(0)


def spread_copies(seeds: DataFrame, most: int) -> DataFrame:
    """One row per copy. Seeds with very many copies are cut into chunks that
    are spread over tasks before they are written out."""
    if most <= COPIES_PER_TASK:
        return seeds.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies")
    chunks = F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / COPIES_PER_TASK).cast("int"))
    chunked = seeds.withColumn("_chunk", F.explode(chunks)).repartition("sample_id", "_chunk")
    first = F.col("_chunk") * COPIES_PER_TASK + 1
    last = F.least(F.col("_copies"), (F.col("_chunk") + 1) * COPIES_PER_TASK)
    return chunked.withColumn("_copy", F.explode(F.sequence(first, last))).drop("_copies", "_chunk")


def smote(df: DataFrame, k: int = fv.SMOTE_NEIGHBORS, seed: int = 0, strategy: str | Mapping[int, int] = "auto") -> DataFrame:
    """Original and synthetic samples together, marked by `synthetic`."""
    belongs = [c for c in BELONGS if c in df.columns]
    old = df.select(F.col("sample_id").cast("string").alias("sample_id"), "label", "bands", *belongs).withColumn("synthetic", F.lit(False))
    return old.unionByName(synthetic_samples(df, k, seed, strategy).withColumn("synthetic", F.lit(True)))


def smote_if_needed(
    df: DataFrame, threshold: float = fv.SMOTE_TRIGGER, k: int = fv.SMOTE_NEIGHBORS, seed: int = 0, strategy: str | Mapping[int, int] = "auto"
) -> tuple[DataFrame, bool]:
    """SMOTE when max/min class size is above the threshold."""
    counts = count_map(df)
    if len(counts) < 2 or max(counts.values()) / min(counts.values()) <= threshold:
        return df, False
    return smote(df, k, seed, strategy), True
