import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import samples
from pyspark.sql import functions as F

from bandloom.operators import folds, quality, sampling, spatial
from bandloom.plans.catalogue import places


def features(spark, counts):
    rows = [(i, c) for i, c in enumerate(c for c, n in counts.items() for _ in range(n))]
    return spark.createDataFrame(rows, "fid bigint, class int")


def test_split_five_and_five(spark):
    df = features(spark, {1: 5, 2: 5})
    first = sampling.split_features(df, 0.6).collect()
    assert Counter((r["class"], r["role"]) for r in first) == {
        (1, "train"): 3, (2, "train"): 3, (1, "test"): 2, (2, "test"): 2}
    assert sorted(map(tuple, first)) == sorted(map(tuple, sampling.split_features(df, 0.6).collect()))


def test_split_needs_two_of_every_class(spark):
    with pytest.raises(ValueError, match="fewer than 2"):
        sampling.split_features(features(spark, {1: 4, 2: 1}), 0.6)
    with pytest.raises(ValueError, match="two classes"):
        sampling.split_features(features(spark, {1: 4}), 0.5)
    with pytest.raises(ValueError):
        sampling.split_features(features(spark, {1: 4, 2: 4}), 1.5)


def test_split_preview_counts(spark):
    split = sampling.split_features(features(spark, {1: 10, 2: 10, 3: 10}), 0.75)
    for r in quality.split_preview(split).collect():
        assert r["train"] + r["test"] == 10 and 6 <= r["train"] <= 8
        assert r["small_test"] and not r["severe_imbalance"] and r["missing_in"] is None


def test_pixel_split_floors_and_drops_label_zero(spark):
    df = samples(spark, [[0.0]] * 130, [0] * 30 + [1] * 100)
    got = sampling.split_pixels(df, 29, seed=1)
    assert got.filter("role = 'train'").count() == int(100 * (29 / 100.0)) and got.count() == 100
    assert sampling.split_pixels(df, 100).filter("role = 'test'").count() == 0


def test_polygon_coverage_names_thin_classes(spark):
    rows = list(zip([1, 1, 2, 2, 2, 3], [10, 10, 20, 21, 21, 30]))
    df = spark.createDataFrame(rows, "label int, polygon_id bigint")
    assert sorted(map(tuple, folds.polygon_coverage(df, 2).collect())) == [(1, 1), (3, 1)]
    with pytest.raises(folds.TooFewPolygons):
        folds.require_polygons(df, 2)


def test_group_folds_keep_groups_whole_and_even(spark):
    rows = [(i, (i // 7) % 3, i // 7) for i in range(2100)]
    df = spark.createDataFrame(rows, "sample_id bigint, label int, polygon_id bigint")
    got = folds.stratified_group_kfold(df, 3, seed=4)
    assert got.groupBy("polygon_id").agg(F.countDistinct("fold").alias("f")).filter("f > 1").count() == 0
    sizes = [r["count"] for r in got.groupBy("label", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 14


def test_kfold_lowers_k(spark):
    df = samples(spark, [[0.0]] * 13, [1] * 10 + [2] * 3)
    assert {r["fold"] for r in folds.stratified_kfold(df, 8).collect()} == {0, 1, 2}


@pytest.fixture(scope="module")
def line(spark):
    """Three classes on a line, one unit apart within a class."""
    rows = [(c * 100 + i, c, float(i), 0.0, [float(i)]) for c in (1, 2, 3) for i in range(20 + c)]
    return spark.createDataFrame(rows, "sample_id bigint, label int, x double, y double, bands array<double>").cache()


def test_sloo_sizes_are_counted_by_hand(spark, line):
    held, near = folds.sloo_folds(line, 3.0, max_iter=4, seed=1)
    sizes = {(r["iter"], r["label"]): (r["held_out"], r["n_train"]) for r in folds.sloo_sizes(line, held, near).collect()}
    points = {r["sample_id"]: (r["label"], r["x"]) for r in line.collect()}
    assert len(sizes) == 12
    for (_, label), (out, n) in sizes.items():
        x = points[out][1]
        assert points[out][0] == label
        assert n == sum(1 for c, v in points.values() if c == label and abs(v - x) >= 3.0)


def test_sloo_default_is_strict(spark, line):
    held, near = folds.sloo_folds(line, 3.0, seed=1)
    assert held.count() == 3 * 21
    points = {r["sample_id"]: (r["label"], r["x"]) for r in line.collect()}
    for r in folds.sloo_sizes(line, held, near).collect():
        x = points[r["held_out"]][1]
        assert r["n_train"] == sum(1 for c, v in points.values() if c == r["label"] and abs(v - x) > 3.0)
    kept = folds.sloo_training(line, near, 2)
    gone = near.filter("iter = 2").count()
    assert kept.count() == line.count() - gone


def slow_farthest(points, mine, center, want):
    away = sorted(mine, key=lambda i: (-math.dist(points[i], center), hashlib.md5(f"1|{i}".encode()).hexdigest()))
    return set(away[:want])


def cloud(spark, n=3000):
    """Three classes, one of them mostly on one place, one row without a position."""
    rng = np.random.RandomState(4)
    rows = [(i, 1 + i % 3, *(map(float, (7.0, 7.0) if i % 3 == 0 and i > 30 else np.round(rng.normal(0, 50, 2), 1)))) for i in range(n)]
    return spark.createDataFrame([*rows, (n, 1, None, 1.0), (n + 1, 4, 0.0, 0.0)], "sample_id bigint, label int, x double, y double")


def test_farthest_samples_equal_all_distances_sorted(spark, monkeypatch):
    monkeypatch.setattr(spatial, "LEAF_ROWS", 8)
    df = cloud(spark)
    points = {r.sample_id: (r.x, r.y) for r in df.collect() if r.x is not None}
    classes = {r.sample_id: r.label for r in df.collect()}
    held = folds.sloo_held_out(df.filter("label < 4"), 4, seed=1)
    held = held.unionByName(df.filter("label = 4").withColumn("iter", F.lit(0)), allowMissingColumns=True)
    for want in (1, 5, 40):
        got = defaultdict(set)
        for r in spatial.farthest(df, held, want, 1).collect():
            assert r.sample_id not in got[r.iter, r.label]
            got[r.iter, r.label].add(r.sample_id)
        for h in held.filter("x is not null").collect():
            mine = [i for i in points if classes[i] == h.label]
            assert got[h.iter, h.label] == slow_farthest(points, mine, (h.x, h.y), want)
    tied = spatial.farthest(df, held, 2, 1, ties=True).groupBy("iter", "label").count()
    assert tied.filter("count < 2 and label < 4").count() == 0


def test_sides_with_a_number_of_held_out_samples(spark, line):
    sides = folds.sloo_sides(line, 2.0, seed=1, min_train=4)
    place = {r.sample_id: (r.label, r.x) for r in line.collect()}
    drawn = {(r.iter, r.label): r.x for r in folds.sloo_held_out(line, None, seed=1).collect()}
    for i in sides.iterations[:3]:
        valid, train = sides.validation(i).collect(), {r.sample_id for r in sides.training(i).collect()}
        for c in (1, 2, 3):
            mine = {k: abs(x - drawn[i, c]) for k, (label, x) in place.items() if label == c}
            held = {r.sample_id for r in valid if r.label == c}
            assert len(held) == 4 and min(mine[k] for k in held) >= max(v for k, v in mine.items() if k not in held)
            assert {k for k in train if place[k][0] == c} == {k for k, v in mine.items() if v > 2.0 and k not in held}
    sizes = {(r.iter, r.label): (r.n_train, r.n_valid) for r in sides.sizes().collect()}
    assert sizes[0, 1] == (sides.training(0).filter("label = 1").count(), 4)
    both = folds.sloo_sides(line, 2.0, seed=1, min_train=4, sloo=False)
    assert both.training(0).count() + both.validation(0).count() == line.count()


@pytest.mark.parametrize("share", [0.0, 0.02, 0.25, 0.99])
def test_sides_with_a_share_of_the_class(spark, line, share):
    sides = folds.sloo_sides(line, 2.0, seed=1, min_train=share)
    place = {r.sample_id: (r.label, r.x) for r in line.collect()}
    drawn = {(r.iter, r.label): (r.sample_id, r.x) for r in folds.sloo_held_out(line, None, seed=1).collect()}
    seen = []
    for i in sides.iterations[:4]:
        valid, train = {r.sample_id for r in sides.validation(i).collect()}, {r.sample_id for r in sides.training(i).collect()}
        assert not valid & train
        for c in (1, 2, 3):
            own, x0 = drawn[i, c]
            mine = [k for k, (label, _) in place.items() if label == c]
            free = {k for k in mine if abs(place[k][1] - x0) > 2.0}
            quota = min(max(0, int(share * len(mine)) - 1), len(free))
            held = valid & set(mine)
            assert own in held and held <= free | {own} and len(held) == quota + 1 and train & set(mine) == free - held
        seen.append(frozenset(valid))
    assert len(set(seen)) > 1


def test_stand_sides(spark):
    rows = [(i, 1 + i % 2, i % 12) for i in range(240)]
    df = spark.createDataFrame(rows, "sample_id bigint, label int, stand_id bigint")
    sides = folds.stand_sides(df, 3, seed=3)
    held = {(r.iter, r.label): r.stand_id for r in folds.stand_folds(df, 3, True, seed=3).collect()}
    for i in range(3):
        assert {(r.label, r.stand_id) for r in sides.validation(i).collect()} == {(c, held[i, c]) for c in (1, 2)}
        assert sides.training(i).count() == 200 and sides.training(i).columns == df.columns


def test_stand_folds(spark):
    rows = [(i, 1 + i % 2, i % 12) for i in range(240)]
    df = spark.createDataFrame(rows, "sample_id bigint, label int, stand_id bigint")
    assert folds.min_stands_per_class(df).first()[0] == 6
    one = folds.stand_folds(df, sloo=True, seed=3)
    assert one.groupBy("iter", "label").count().filter("count <> 1").count() == 0
    assert one.select("iter").distinct().count() == 6
    half = folds.stand_fold_sizes(df, folds.stand_folds(df, 3, sloo=False, seed=3))
    assert {(r["n_train"], r["n_valid"]) for r in half.collect()} == {(60, 60)}


def test_draws_come_with_replacement(spark):
    df = samples(spark, [[float(i)] for i in range(20)], [1] * 20)
    got = sampling.draw_rows(df, 200, seed=5)
    assert got.count() == 200 and got.select("draw").distinct().count() == 200
    assert got.select("sample_id").distinct().count() > 10


def test_fast_mode(spark):
    small = samples(spark, [[0.0]] * 50, [1] * 30 + [2] * 20)
    row = sampling.fast_mode_policy(small).first()
    assert row["fast_mode"] and row["folds"] == 2 and row["trials"] == 25
    assert not sampling.fast_mode_policy(small, enabled=False).first()["fast_mode"]


def test_geodesic_pairs_of_a_tall_raster_are_its_grid_neighbours(spark, tmp_path):
    # Rows near 9,000 lay at a pole, rows near 36,000 where the raster began.
    keys = [k for start in (0, 899_500, 3_599_500, 9_000_000) for k in range(start, start + 700)]
    rows = [(k, k % 7, "O", 1.0, f"{k // 3 % 2 + 1}-X") for k in keys]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    label = lambda k: k // 3 % 2 + 1
    held = set(keys)
    want = {(label(k), k, n) for k in keys for n in (k + 100, k + 1) if n in held and label(k) == label(n) and (n == k + 100 or n % 100)}
    got = places.geodesic_pairs(spark, str(tmp_path))
    assert len(want) > 2000 and sorted(map(tuple, got.collect())) == sorted(want)
    # The copies of a point are many times what Spark expects, so they are never broadcast.
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_group_folds_read_the_samples_no_more_than_needed(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("bigint")
    def seen(i):
        read.add(1)
        return i

    df = spark.range(400).select(F.col("id").alias("sample_id"), seen("id").alias("_i"), (F.col("id") % 3).cast("int").alias("label"))
    df = df.withColumn("polygon_id", F.floor(F.col("_i") / 4))
    got = folds.stratified_group_kfold(df.select("sample_id", "label", "polygon_id"), 3, seed=5).collect()
    assert len(got) == 400 and all(len({r["fold"] for r in got if r["polygon_id"] == p}) == 1 for p in range(100))
    # Once for the groups; the join evaluates the function in its filter as well.
    assert read.value <= 1200
