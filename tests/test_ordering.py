import hashlib
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from bandloom.functions import ordering as od
from bandloom.operators import sampling


def hashed(seed, i):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows."""
    rows = [(i, 1 if i % 10 else 2 + i % 3, float(i % 37)) for i in range(3000)]
    return spark.createDataFrame(rows, "sample_id bigint, label int, v double").cache()


def test_hash_rank_is_row_number(spark, skewed):
    plain = Window.partitionBy("label").orderBy(od.seeded_hash(5, "sample_id"), "sample_id")
    want = skewed.withColumn("want", F.row_number().over(plain))
    assert od.hash_rank(want, ["label"], "sample_id", 5).filter("rank <> want").count() == 0


def test_lead_rank_is_row_number(spark, skewed):
    plain = Window.partitionBy("label").orderBy(F.desc("v"), od.seeded_hash(5, "sample_id"), "sample_id")
    want = skewed.withColumn("want", F.row_number().over(plain))
    assert od.lead_rank(want, ["label"], "v", "sample_id", 5).filter("rank <> want").count() == 0


def test_take_per_key_takes_the_first_by_hash(spark, skewed):
    quota = {1: 1234, 2: 0, 3: 5, 4: 10**6}
    got = od.take_per_key(skewed, "label", quota, "sample_id", 9).filter("chosen").collect()
    for label, k in quota.items():
        mine = sorted((hashed(9, r["sample_id"]), r["sample_id"]) for r in skewed.filter(F.col("label") == label).collect())
        assert {r["sample_id"] for r in got if r["label"] == label} == {i for _, i in mine[:k]}


def test_rows_at_ranks_repeat_what_is_asked_twice(spark, skewed):
    wanted = spark.createDataFrame([(1, 7, "a"), (1, 7, "b"), (1, 2000, "c"), (3, 1, "d")], "label int, rank bigint, tag string")
    got = {r["tag"]: r["sample_id"] for r in od.rows_at_ranks(skewed, "label", wanted, "sample_id", 2).collect()}
    order = lambda c: sorted((hashed(2, r["sample_id"]), r["sample_id"]) for r in skewed.filter(F.col("label") == c).collect())
    assert got == {"a": order(1)[6][1], "b": order(1)[6][1], "c": order(1)[1999][1], "d": order(3)[0][1]}


def test_running_sums_match_a_plain_window(spark):
    rng = random.Random(3)
    rows = [(k, v, rng.randint(1, 9)) for k in (1, 2) for v in sorted({rng.choice([0.5, rng.random() ** 8]) for _ in range(800)})]
    df = spark.createDataFrame(rows, "k int, v double, n bigint")
    plain = Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("want", F.sum("n").over(plain))
    assert od.running_sums(want, ["k"], "v", ["n"], buckets=16).filter("cum_n <> want").count() == 0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.0, 1.0, 2.5, 7.25, 9.0]), min_size=1, max_size=40), st.floats(0, 1))
def test_exact_quantiles_match_numpy(spark, values, p):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert od.exact_quantiles(df, "v", [p]).first()[0] == pytest.approx(np.quantile(values, p))


def test_allocation_by_largest_remainder():
    assert sampling.allocate_training({1: 5, 2: 5}, 6) == {1: 3, 2: 3}
    assert sampling.allocate_training({1: 10, 2: 10, 3: 10}, 22) == {1: 7, 2: 7, 3: 8}
    with pytest.raises(ValueError):
        sampling.allocate_training({1: 2, 2: 2}, 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(2, 60), min_size=2, max_size=6), st.floats(0.05, 0.95))
def test_allocation_keeps_both_sides(counts, share):
    named = dict(enumerate(counts))
    n_train = min(max(len(counts), round(share * sum(counts))), sum(counts) - len(counts))
    got = sampling.allocate_training(named, n_train)
    assert sum(got.values()) == n_train
    assert all(1 <= got[c] < named[c] for c in named)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 500), min_size=1, max_size=6), st.integers(6, 400))
def test_subset_targets_fill_the_limit(counts, limit):
    named = dict(enumerate(counts))
    got = sampling.subset_targets(named, limit)
    assert sum(got.values()) == min(limit, sum(counts))
    assert all(1 <= got[c] <= named[c] for c in named)
