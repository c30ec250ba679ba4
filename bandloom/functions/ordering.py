"""Seeded order, ranks and running sums that never put one class in one task.

A plain `row_number() over (partition by class order by hash)` sorts every row of
a class in a single task. Here rows are first counted per (class, bucket), where
buckets follow the order, so only rows of one bucket are ever sorted together.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom.functions.sizing import TooLarge, bounded_rows, lookup_join

HASH_DIGITS = 3  # hex digits of the hash that form a bucket: 16^3 buckets per class
BUCKET_ROWS = 2_000_000  # (class, bucket) counts the driver may hold


def seeded_hash(seed: int | str, *parts: Column | str) -> Column:
    """md5 hex of `seed|part|part...`; the seeded random order of the engine."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def hash_uint(hex_col: Column, digits: int = 8) -> Column:
    """The leading hex digits of a hash as a whole number."""
    return F.conv(F.substring(hex_col, 1, digits), 16, 10).cast("bigint")


def hash_unit(hex_col: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return hash_uint(hex_col) / F.lit(float(16**8))


def hash_rank(
    df: DataFrame,
    keys: Sequence[str],
    id_col: str,
    seed: int | str,
    out: str = "rank",
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Add the 1-based rank of each row within `keys` in seeded hash order.

    Equals `row_number() over (partition by keys order by md5(seed|id), id)`.
    Ranking and the offset join share the partitioning (keys, bucket).
    """
    keys = list(keys)
    hashed = df.withColumn("_h", seeded_hash(seed, id_col)).withColumn("_b", F.substring("_h", 1, digits))
    per_bucket = hashed.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_bucket.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_b").orderBy("_h", id_col)
    ranked = hashed.withColumn("_rn", F.row_number().over(inside))
    joined = ranked.join(offsets, [*keys, "_b"])
    return joined.withColumn(out, F.col("_before") + F.col("_rn")).select(*df.columns, out)


def lead_rank(
    df: DataFrame,
    keys: Sequence[str],
    lead: str,
    id_col: str,
    seed: int | str,
    out: str = "rank",
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Rank within `keys` by `lead` descending, then in seeded hash order.

    Offsets come in two steps, rows above a lead value and rows above a bucket
    within it, so neither many lead values nor one huge one meet in one task.
    """
    keys = list(keys)
    hashed = df.withColumn("_h", seeded_hash(seed, id_col)).withColumn("_b", F.substring("_h", 1, digits))
    per_bucket = hashed.groupBy(*keys, lead, "_b").agg(F.count(F.lit(1)).alias("_n"))
    per_lead = per_bucket.groupBy(*keys, lead).agg(F.sum("_n").alias("_m"))
    above = Window.partitionBy(*keys).orderBy(F.desc(lead)).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys, lead).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    lead_offsets = per_lead.select(*keys, lead, F.coalesce(F.sum("_m").over(above), F.lit(0)).alias("_above"))
    offsets = per_bucket.select(*keys, lead, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")).join(
        lead_offsets, [*keys, lead]
    )
    inside = Window.partitionBy(*keys, lead, "_b").orderBy("_h", id_col)
    joined = hashed.withColumn("_rn", F.row_number().over(inside)).join(offsets, [*keys, lead, "_b"])
    rank = F.col("_above") + F.col("_before") + F.col("_rn")
    return joined.withColumn(out, rank).select(*df.columns, out)


def rows_at_ranks(
    df: DataFrame,
    key: str,
    wanted: DataFrame,
    id_col: str,
    seed: int | str,
    digits: int = HASH_DIGITS,
) -> DataFrame:
    """Rows of `df` at given ranks per key, in seeded hash order.

    `wanted` has `key`, `rank` and any further columns; a rank asked for twice
    gives two rows. Only buckets that hold a wanted rank are sorted.
    """
    hashed = df.withColumn("_h", seeded_hash(seed, id_col)).withColumn("_b", F.substring("_h", 1, digits))
    per_bucket = hashed.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(key).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # Ranks are cut into even stretches, about as many as there are buckets. A bucket
    # overlaps few stretches and a rank lies in one, so they meet by equality.
    stretch = F.greatest(F.lit(1), F.ceil(F.col("_total") / 16**digits))
    spans = (
        per_bucket.withColumn("_upto", F.sum("_n").over(upto))
        .withColumn("_total", F.sum("_n").over(every))
        .withColumn("_from", F.col("_upto") - F.col("_n"))
        .withColumn("_w", stretch)
        .withColumn("_cell", F.explode(F.sequence(F.floor(F.col("_from") / F.col("_w")), F.floor((F.col("_upto") - 1) / F.col("_w")))))
    )
    widths = per_bucket.groupBy(key).agg(F.sum("_n").alias("_total")).select(key, stretch.alias("_w"))
    extra = [c for c in wanted.columns if c not in (key, "rank")]
    celled = lookup_join(wanted, widths, [key], "inner").withColumn("_cell", F.floor((F.col("rank") - 1) / F.col("_w"))).drop("_w")
    placed = (
        celled.join(spans, [key, "_cell"])
        .filter((F.col("rank") > F.col("_from")) & (F.col("rank") <= F.col("_upto")))
        .select(key, "_b", *extra, (F.col("rank") - F.col("_from")).alias("_rn"))
    )
    used = placed.select(key, "_b").distinct()
    inside = Window.partitionBy(key, "_b").orderBy("_h", id_col)
    ranked = lookup_join(hashed, used, [key, "_b"], "inner").withColumn("_rn", F.row_number().over(inside))
    return ranked.join(placed, [key, "_b", "_rn"]).select(*df.columns, *extra)


def bucket_counts(hashed: DataFrame, key: str) -> dict:
    """Rows per (key, bucket) as key -> sorted [(bucket, n)], on the driver.

    With more classes the buckets get coarser, so the table stays bounded.
    """
    for digits in (HASH_DIGITS, 1):
        counts = hashed.groupBy(key, F.substring("_h", 1, digits).alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
        try:
            rows = bounded_rows(counts, BUCKET_ROWS)
        except TooLarge:
            if digits == 1:
                raise
            continue
        out: dict = {}
        for k, b, n in rows:
            out.setdefault(k, []).append((b, n))
        return {k: sorted(v) for k, v in out.items()}
    return {}


def hash_cuts(df: DataFrame, key: str, quota: dict | Callable[[dict], dict], id_col: str, seed: int | str) -> dict:
    """Per key, the hash of the quota-th row in seeded order.

    A row belongs to the first `quota[key]` rows of its key exactly when its hash
    is not above the cut, so taking them later is a filter without a shuffle.
    Rows are counted per bucket, and only the one bucket per key that the quota
    falls into is sorted. `quota` may be computed from the rows per key.
    """
    hashed = df.filter(F.col(key).isNotNull()).select(key, F.col(id_col).alias("_id"), seeded_hash(seed, id_col).alias("_h"))
    counts = bucket_counts(hashed, key)
    if callable(quota):
        quota = quota({k: sum(n for _, n in v) for k, v in counts.items()})
    cuts, edges = {}, []
    for k, buckets in counts.items():
        wanted, passed = int(quota.get(k) or 0), 0
        if wanted <= 0:
            continue
        cuts[k] = "g"  # above every hex digit: the whole class is taken
        for b, n in buckets:
            if passed + n >= wanted:
                if passed + n > wanted:
                    edges.append((k, b, wanted - passed))
                else:
                    cuts[k] = b + "g"  # exactly up to the end of this bucket
                break
            passed += n
    if not edges:
        return cuts
    digits = len(edges[0][1])
    local = df.sparkSession.createDataFrame(
        edges, schema=_schema((key, df.schema[key].dataType), ("_b", "string"), ("_need", "bigint")))
    within = Window.partitionBy(key).orderBy("_h", "_id")
    found = (
        hashed.withColumn("_b", F.substring("_h", 1, digits))
        .join(F.broadcast(local), [key, "_b"])
        .withColumn("_rn", F.row_number().over(within))
        .filter(F.col("_rn") == F.col("_need"))
        .select(key, "_h")
    )
    cuts.update({r[0]: r[1] for r in bounded_rows(found)})
    return cuts


def below_cut(df: DataFrame, key: str, cuts: dict, id_col: str, seed: int | str, out: str = "chosen") -> DataFrame:
    """Add a boolean: is the row among the first rows its key's cut allows?"""
    if not cuts:
        return df.withColumn(out, F.lit(False))
    table = df.sparkSession.createDataFrame(
        list(cuts.items()), schema=_schema((key, df.schema[key].dataType), ("_cut", "string"))
    )
    return (
        df.join(F.broadcast(table), key, "left")
        .withColumn(out, F.coalesce(seeded_hash(seed, id_col) <= F.col("_cut"), F.lit(False)))
        .select(*df.columns, out)
    )


def take_per_key(
    df: DataFrame, key: str, quota: dict | Callable[[dict], dict], id_col: str, seed: int | str, out: str = "chosen"
) -> DataFrame:
    """Mark the first `quota[key]` rows of every key in seeded order."""
    return below_cut(df, key, hash_cuts(df, key, quota, id_col, seed), id_col, seed, out)


def running_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: Sequence[str],
    buckets: int | None = None,
) -> DataFrame:
    """Add `cum_<col>`: the running sum of each column in ascending `order`.

    `df` must hold one row per (keys, order), i.e. ties are already summed up.
    Bucket edges come from a quantile sketch per key, so buckets are even even
    when the values are not; only rows of one bucket are sorted together.
    """
    keys = list(keys)
    if buckets is None:
        buckets = min(max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), 1024)
    steps = [i / buckets for i in range(1, buckets)]
    sketch = F.percentile_approx(F.col(order), F.array(*[F.lit(s) for s in steps]), F.lit(10 * buckets))
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    rows = bounded_rows(grouped.agg(F.array_distinct(sketch).alias("_edges")))
    if keys:
        fields = [(k, df.schema[k].dataType) for k in keys]
        table = df.sparkSession.createDataFrame(
            [tuple(r) for r in rows], schema=_schema(*fields, ("_edges", f"array<{df.schema[order].dataType.simpleString()}>"))
        )
        placed = df.join(F.broadcast(table), keys, "left")
    else:
        edges = rows[0]["_edges"] or []
        kind = df.schema[order].dataType
        placed = df.withColumn("_edges", F.array(*[F.lit(e).cast(kind) for e in edges]).cast(f"array<{kind.simpleString()}>"))
    # Every 32nd edge first, then the edges between two of them: two short searches.
    below = lambda e: e < F.col(order)
    coarse = F.filter("_edges", lambda e, i: (i % 32 == 31) & (e < F.col(order)))
    placed = placed.withColumn("_coarse", F.size(coarse) * 32)
    fine = F.slice("_edges", F.col("_coarse") + 1, F.lit(32))
    placed = placed.withColumn("_bucket", F.col("_coarse") + F.size(F.filter(fine, below))).drop("_edges", "_coarse")
    totals = placed.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums]
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    running = placed.select("*", *[F.sum(c).over(inside).alias(f"_r_{c}") for c in sums])
    joined = running.join(offsets, [*keys, "_bucket"])
    return joined.select(*df.columns, *[(F.col(f"_o_{c}") + F.col(f"_r_{c}")).alias(f"cum_{c}") for c in sums])


def exact_quantiles(df: DataFrame, value: str, probabilities: Sequence[float]) -> DataFrame:
    """One row with `q<i>` per probability: exact quantiles, linear interpolation.

    Works on counts per distinct value, so copies of a value cost nothing.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    ranked = running_sums(counts, [], value, ["n"])
    total = counts.agg(F.sum("n")).collect()[0][0] or 0
    picks = []
    for i, p in enumerate(probabilities):
        pos = (total - 1) * p
        low, high = int(pos), min(int(pos) + 1, max(total - 1, 0))
        lo = F.max(F.when((F.col("cum_n") - F.col("n") <= low) & (F.col("cum_n") > low), F.col(value)))
        hi = F.max(F.when((F.col("cum_n") - F.col("n") <= high) & (F.col("cum_n") > high), F.col(value)))
        picks.append((lo + (hi - lo) * F.lit(pos - low)).alias(f"q{i}"))
    return ranked.agg(*picks)


def _schema(*fields):
    from pyspark.sql import types as T

    named = {"bigint": T.LongType(), "string": T.StringType()}

    def resolve(kind):
        if not isinstance(kind, str):
            return kind
        if kind in named:
            return named[kind]
        return T.DataType.fromDDL(kind)

    return T.StructType([T.StructField(n, resolve(k)) for n, k in fields])
