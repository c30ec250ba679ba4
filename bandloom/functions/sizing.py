"""Size-checked small tables and the lookup joins built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

# Class codes are unsigned 16-bit, so a per-class table never has more rows.
CLASS_LIMIT = 65_536
# Rows a broadcast side may have before a shuffled join takes over.
BROADCAST_ROWS = 200_000
SALTS = 32
# Rows up to which a lookup table is copied once per salt.
SALTED_ROWS = 500_000


class TooLarge(ValueError):
    """A table that must stay small is not."""


def bounded_rows(df: DataFrame, limit: int = CLASS_LIMIT) -> list[Row]:
    """Rows of a table that must be small; fails instead of collecting more."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise TooLarge(f"more than {limit} rows where a small table is required")
    return rows


def small_or_none(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame | None:
    """A driver-held copy of `df` when it has at most `limit` rows, else None."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    return df.sparkSession.createDataFrame(rows, df.schema)


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "left",
    limit: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join `big` to a lookup table without trusting that the table is small.

    Up to `limit` rows the lookup is broadcast and `big` is not shuffled. A larger
    one is shuffled on the keys plus a salt, so that a key holding a large share
    of `big` is spread over `SALTS` tasks. Where copying it per salt would itself be
    the larger cost, the join is plain and skewed partitions are split at run time.
    """
    on = list(on)
    local = small_or_none(small, limit)
    if local is not None:
        return big.join(F.broadcast(local), on, how)
    if small.select(F.lit(1)).limit(SALTED_ROWS + 1).count() > SALTED_ROWS:
        return big.join(small, on, how)
    others = [c for c in big.columns if c not in on] or on
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*others), F.lit(SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")
