"""Mixing sources to target weights along a curriculum, with native expressions only.

Every source is a stream of its documents in a seeded order, repeated up to `cap`
times. Its weight changes over training time; the integral of the weight gives the
source's cumulative demand, and inverting the demand at a document's place in the
stream gives the training time at which the document is due.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom.llm.positions import cell_widths, order_key, running_sum
from bandloom.llm.words import word_array, word_count
from bandloom.session import cut_lineage

Curve = Sequence[tuple[float, float]]

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
# One curve per weight: (training time, multiplier) knots, straight lines between them.
CURVES: tuple[Curve, ...] = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
SEED = "mix"


def demand_steps(curve: Curve) -> list[tuple[float, float, float, float, float]]:
    """(start time, length, rate at start, rate at end, demand before) per stretch; the whole demand is 1."""
    if len(curve) < 2 or curve[0][0] != 0 or curve[-1][0] != 1:
        raise ValueError("a curve runs from time 0 to time 1")
    areas = [(t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(curve, curve[1:])]
    if min(w for _, w in curve) < 0 or min(t1 - t0 for (t0, _), (t1, _) in zip(curve, curve[1:])) <= 0 or sum(areas) <= 0:
        raise ValueError("times must rise and weights must not be negative")
    whole, before, out = sum(areas), 0.0, []
    for ((t0, w0), (t1, w1)), area in zip(zip(curve, curve[1:]), areas):
        out.append((t0, t1 - t0, w0 / whole, w1 / whole, before))
        before += area / whole
    return out


def time_of(share: Column, curve: Curve) -> Column:
    """Training time at which the demand of a curve reaches `share` (0 to 1)."""
    steps = demand_steps(curve)
    result = None
    for start, length, rate, end, before in reversed(steps):
        over = F.greatest(share - before, F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(rate * rate) + over * (2 * (end - rate) / length), F.lit(0.0)))
        moved = F.when(root + rate == 0, 0.0).otherwise(over * 2 / (root + rate))
        time = F.lit(start) + F.least(moved, F.lit(length))
        result = time if result is None else F.when(share >= before + (rate + end) / 2 * length, result).otherwise(time)
    return result


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Rows (source key, turn, source_size, target) from (src, size).

    Sources take the weights in turn by code point, null last. The words of all
    sources are shared by weight; a target stops at `cap` times its source and the
    excess goes to the others by weight. The filling level is found at once: in the
    order of cap * size / weight, the sources below the level are those that stop.
    One row per source is ordered in one task, never documents.
    """
    per = sizes.groupBy("src").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("turn", F.pmod(F.row_number().over(Window.orderBy("src")) - 1, F.lit(len(weights))).cast("int"))
    per = per.withColumn("weight", F.get(cycle, F.col("turn"))).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by = Window.orderBy(F.col("most") / F.col("weight"), "src")
    everything = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped = F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("weight").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.sum("source_size").over(everything) - stopped) / open_weight)
    per = per.withColumn("at", F.row_number().over(by))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct("at", "level"))
    per = per.withColumn("level", F.min(fits).over(everything)["level"])
    return per.select("src", "turn", "source_size", F.least("most", F.col("level") * F.col("weight")).alias("target"))


def row_key(*columns: str) -> Column:
    """A hash of the values of some columns, nulls told from values."""
    return F.xxhash64(*[F.col(c) for c in columns], *[F.col(c).isNull() for c in columns])


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    cap: int = CAP,
    curves: Sequence[Curve] = CURVES,
    seed: str = SEED,
) -> DataFrame:
    """One row per document: id, size, source_size, target, taken, takes, times, row_key.

    `takes` holds the words taken in each pass over the source (at most `cap`
    passes), `times` the training times at which those passes start. The last
    document of a source's demand is taken in part, so a source's words differ from
    its target by less than one. The order within a source is a seeded digest of the
    id, so reruns agree; rows that repeat an id follow each other by size and content. A null
    text has size 0 and nothing is taken of it; a null source is a source of its own,
    last in order; a null id is placed as an empty one. An empty table gives no rows.
    `row_key` is a hash of id, text and source, by which `training_order` finds the
    documents. Columns other than the three named are ignored.
    """
    if cap < 1 or len(curves) != len(weights):
        raise ValueError("cap is at least one pass, and each weight has a curve")
    name = F.col(source_col).cast("string")
    sizes = docs.select(
        F.col(id_col).alias("id"),
        F.struct(name.isNull().alias("missing"), F.coalesce(name, F.lit("")).alias("name")).alias("src"),
        word_count(F.col(text_col)).alias("size"),
        order_key(F.lit(seed), F.col(id_col)).alias("key"),
        row_key(id_col, text_col, source_col).alias("row_key"),
    )
    sizes = cut_lineage(sizes, "sizes")
    placed = running_sum(sizes, ["src"], "key", "size", "before", cell_widths(sizes.count()), ties=("id", "size", "row_key"))
    joined = placed.join(source_targets(sizes, weights, cap), "src")
    quota = F.floor("target")
    starts = [F.col("before") + F.col("source_size") * e for e in range(math.ceil(cap))]
    takes = [F.least(F.col("size"), F.greatest(quota - s, F.lit(0))).cast("bigint") for s in starts]
    share = lambda s: F.when(F.col("target") > 0, F.least(s / F.col("target"), F.lit(1.0))).otherwise(0.0)

    def due(start: Column) -> Column:
        at = time_of(share(start), curves[-1])
        for turn, curve in list(enumerate(curves))[-2::-1]:
            at = F.when(F.col("turn") == turn, time_of(share(start), curve)).otherwise(at)
        return at

    return joined.select(
        F.col("id").alias(id_col),
        "size",
        "source_size",
        "target",
        sum(takes[1:], takes[0]).alias("taken"),
        F.array(*takes).alias("takes"),
        F.array(*[F.when(t > 0, due(s)) for t, s in zip(takes, starts)]).alias("times"),
        "row_key",
    )


def training_order(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of `docs` as training meets them, range-sorted by training time.

    A document stands once for each pass that takes words of it; the one taken in
    part is cut after its last word taken (its words joined by single spaces). Rows
    without an id and rows that repeat one are placed like any other: rows meet
    their passes by id, text and source, and m rows that are equal in these share
    the passes of the m, one row each. Columns stay as they are.
    """
    named = [id_col, text_col, source_col]
    rest = [c for c in docs.columns if c not in named]
    values = {c: F.col("one")[f"v{i}"] for i, c in enumerate(named)} | {c: F.col("z.other")[f"v{i}"] for i, c in enumerate(rest)}
    one = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(named)])
    other = F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"v{i}") for i, c in enumerate(rest)])
    rows = docs.select(row_key(*named).alias("row_key"), one.alias("one"), other.alias("other"))
    rows = rows.groupBy("row_key").agg(F.first("one").alias("one"), F.collect_list("other").alias("other"))
    passes = mixed.groupBy("row_key").agg(F.sort_array(F.collect_list(F.struct("size", "takes", "times"))).alias("mix"))
    each = rows.join(passes, "row_key").select("one", F.explode(F.arrays_zip("other", "mix")).alias("z"))
    each = each.select("one", "z", F.posexplode(F.arrays_zip("z.mix.takes", "z.mix.times")).alias("pass", "due"))
    each = each.withColumn("take", F.col("due")["takes"]).withColumn("time", F.col("due")["times"]).filter("take > 0")
    text = values[text_col]
    cut = F.when(F.col("take") < F.col("z.mix.size"), F.array_join(F.slice(word_array(text), 1, F.col("take").cast("int")), " ")).otherwise(text)
    each = each.withColumn("id", values[id_col])
    ordered = each.repartitionByRange("time", "id", "pass").sortWithinPartitions("time", "id", "pass")
    return ordered.select(*[(cut if c == text_col else values[c]).alias(c) for c in docs.columns])
