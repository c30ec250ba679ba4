import json

import numpy as np
import pytest
from helpers import blobs, cells, samples
from pyspark.sql import Row
from pyspark.sql import functions as F

from bandloom.functions import geometry as geo
from bandloom.functions import scalar
from bandloom.operators import explain, learners, oversample, prepare, quality, spatial, tuning
from bandloom.plans import classify
from bandloom.plans.train import train
from bandloom.sources import reports, tables
from bandloom.streaming import gaussian as streams


@pytest.fixture(scope="module")
def grid(spark):
    """60 by 80 pixels, three bands, a nodata strip and a masked corner."""
    rng = np.random.RandomState(0)
    rows = []
    for r in range(60):
        for c in range(80):
            base = 1 + (c // 27)
            bands = [float(v) for v in rng.normal(scale=0.5, size=3) + 4 * base]
            if r == 10:
                bands[0] = -9999.0
            rows.append(("scene", r, c, c + 0.5, r + 0.5, bands, int(not (r < 5 and c < 5))))
    return spark.createDataFrame(
        rows, "raster_id string, row int, col int, x double, y double, bands array<double>, mask int").cache()


def ring(*points):
    return [Row(x=float(x), y=float(y)) for x, y in points]


@pytest.fixture(scope="module")
def polygons(spark):
    rows = [
        (1, "1", 10, "a", ring((1.2, 1.2), (20.2, 1.2), (20.2, 30.2), (1.2, 30.2))),
        (2, "2", 20, "", ring((30.2, 5.2), (50.2, 5.2), (50.2, 40.2), (40.2, 20.2), (30.2, 40.2))),
        (3, "3", 30, "c", ring((55.2, 2.2), (78.2, 2.2), (78.2, 58.2), (55.2, 58.2))),
        (4, "1", 10, "a", ring((60.2, 10.2), (64.2, 10.2), (64.2, 14.2), (60.2, 14.2))),
        (5, "", 40, "x", ring((0.2, 40.2), (9.2, 40.2), (9.2, 50.2), (0.2, 50.2))),
        (6, "3", 30, "c", ring((55.2, 2.2), (78.2, 2.2), (78.2, 58.2), (55.2, 58.2))),
    ]
    return spark.createDataFrame(
        rows, "fid bigint, class string, stand_id bigint, label_name string, ring array<struct<x:double,y:double>>")


def crossing(points, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


@pytest.mark.parametrize("base", [2.0, 16.0])
@pytest.mark.parametrize("broadcast", [True, False])
def test_burn_equals_brute_force(spark, grid, polygons, base, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(spatial, "BROADCAST_ROWS", 0)
    usable = tables.labelled_polygons(polygons)
    got = {}
    for r in spatial.polygon_matches(grid.select(*tables.PIXEL_KEY, "x", "y"), usable, ["fid"], base).collect():
        got.setdefault((r["row"], r["col"]), set()).add(r["fid"])
    shapes = {p["fid"]: [(v["x"], v["y"]) for v in p["ring"]] for p in usable.collect()}
    for r in range(60):
        for c in range(80):
            want = {f for f, s in shapes.items() if crossing(s, c + 0.5, r + 0.5)}
            assert got.get((r, c), set()) == want


def test_later_polygons_overwrite(grid, polygons):
    burned = spatial.rasterize_labels(grid, tables.labelled_polygons(polygons.filter("fid < 6")))
    at = {(r["row"], r["col"]): (r["label"], r["polygon_id"], r["stand_id"]) for r in burned.collect()}
    assert at[(12, 62)] == (1, 4, 10) and at[(20, 62)] == (3, 3, 30) and (45, 5) not in at


def test_names_prefer_the_manual_map(polygons):
    usable = tables.labelled_polygons(polygons)
    assert dict(spatial.label_names(usable, {2: "two"}).collect()) == {1: "a", 2: "two", 3: "c"}


def test_quality_report_and_duplicates(spark, polygons):
    usable = tables.labelled_polygons(polygons)
    assert quality.duplicate_features(usable).first()[0] == 1
    broken = usable.unionByName(usable.filter("fid = 1").withColumn("ring", F.slice("ring", 1, 2)))
    rows = {r["check"]: r["severity"] for r in quality.training_quality_report(broken).collect()}
    assert rows == {"small_dataset": "warning", "low_class_count": "critical", "invalid_geometry": "critical",
                    "duplicates": "warning"}


def test_wkt_rings(spark):
    df = spark.createDataFrame([("POLYGON ((0 0, 4 0, 4 3, 0 0))",)], "wkt string")
    got = df.select(tables.ring_from_wkt(F.col("wkt")).alias("r")).first()["r"]
    assert [(p["x"], p["y"]) for p in got] == [(0, 0), (4, 0), (4, 3)]
    assert df.select(geo.signed_area(tables.ring_from_wkt(F.col("wkt"))).alias("a")).first()["a"] == 6


def test_geodesic_known_lengths(spark):
    rows = [(0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 1.0, 0.0), (-0.127, 51.507, 2.352, 48.857), (5.0, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [r[0] for r in df.select(geo.geodesic(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect()]
    assert got[0] == pytest.approx(110574.39, abs=0.1) and got[1] == pytest.approx(111319.49, abs=0.1)
    assert 340_000 < got[2] < 345_500 and got[3] == 0


def test_geodesic_pairs_equal_brute_force(spark):
    rng = np.random.RandomState(2)
    at = rng.uniform([10.0, 60.0], [10.05, 60.03], size=(60, 2))
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(at)], "sample_id bigint, x double, y double")
    got = {(r["a_sample_id"], r["b_sample_id"]) for r in spatial.geodesic_pairs(df, 600.0).collect()}
    i, j = np.triu_indices(60, 1)
    dist = geo._vincenty(at[i, 0], at[i, 1], at[j, 0], at[j, 1])
    assert got == {(int(a), int(b)) for a, b, v in zip(i, j, dist) if v <= 600.0}


def test_pairs_count_copies_instead_of_pairing_them(spark):
    rows = [(i, 0.0, 0.0) for i in range(50)] + [(50, 1.0, 0.0), (51, 9.0, 0.0)]
    df = spark.createDataFrame(rows, "sample_id bigint, x double, y double")
    got = spatial.pairwise_distance(df, 2.0).collect()
    assert [(r["a_sample_id"], r["a_copies"], r["b_sample_id"], r["distance"]) for r in got] == [(0, 50, 50, 1.0)]


def test_constant_bands_pass_through(spark):
    df = samples(spark, [[0.0, 7.0], [10.0, 7.0]], [1, 2])
    got = prepare.fit_scaler(df).transform(df).orderBy("sample_id").collect()
    assert [list(r["bands"]) for r in got] == [[-1.0, 7.0], [1.0, 7.0]]


def test_whole_flow_on_a_raster(spark, grid, polygons, tmp_path):
    usable = tables.labelled_polygons(polygons)
    burned = spatial.rasterize_labels(prepare.valid_pixels(grid), usable)
    labelled = burned.withColumn("sample_id", F.concat_ws("_", "row", "col"))
    result = train(labelled.select("sample_id", "label", "bands", "polygon_id"), code="GMM", split=60, seed=1)
    assert result.scores().first()["overall_accuracy"] > 0.95
    predictions, summary = classify.classify_batch(grid, result.fitted, result.scaler)
    row = summary.first()
    assert row["pixels"] == 4800 and row["classified"] == 4720 and row["success"]
    maps = tables.class_map(grid, predictions, masked=False)
    tables.write_class_map(maps, str(tmp_path / "map"))
    back = spark.read.parquet(str(tmp_path / "map"))
    assert dict(back.dtypes)["class"] == "smallint" and back.count() == 4800
    assert back.filter("class = 0").count() == 80
    conf = tables.confidence_map(grid, predictions)
    assert conf.filter("confidence = -1").count() == 80 and conf.agg(F.max("confidence")).first()[0] <= 100
    assert classify.assess_map(classify.predict_raster(grid, result.fitted, result.scaler, keep=["x", "y"]), usable).first()["overall_accuracy"] > 0.9


def test_prediction_needs_no_shuffle(grid, polygons):
    usable = tables.labelled_polygons(polygons)
    burned = spatial.rasterize_labels(prepare.valid_pixels(grid), usable).withColumn("sample_id", F.concat_ws("_", "row", "col"))
    result = train(burned.select("sample_id", "label", "bands"), code="GMM", split=100)
    plan = classify.predict_raster(grid, result.fitted, result.scaler)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("settings", [
    {"code": "NB", "split": 70, "search": "grid", "grid": {"var_smoothing": [1e-9, 1e-3]}},
    {"code": "RF", "split": 70, "params": {"n_estimators": 5}, "use_smote": True, "class_weights": "balanced"},
    {"code": "GMM", "split": 70, "legacy_order": True},
    {"code": "LR", "split": 70, "search": "random", "trials": 2, "folds": 2},
    {"code": "GMM", "split": 70, "search": "grid", "grid": {"tau": [0.0, 0.1]}, "polygon_groups": True, "folds": 2},
    {"code": "GMM", "split": "STAND", "max_iter": 2},
    {"code": "GMM", "split": "SLOO", "distance": 1.5, "max_iter": 3},
    {"code": "GMM", "split": "SLOO", "distance": 1.5, "max_iter": 2, "min_train": 3, "search": "grid", "grid": {"tau": [0.0, 0.1]}},
    {"code": "KNN", "split": "SLOO", "distance": 1.5, "max_iter": 2, "min_train": 0.2, "search": "grid", "grid": {"n_neighbors": [1, 3]}},
    {"code": "GMM", "split": "STAND", "max_iter": 2, "sloo": True, "use_smote": True, "smote_strategy": {3: 70}, "search": "grid", "grid": {"tau": [0.0, 0.1]}},
    {"code": "NB", "split": "STAND", "max_iter": 2, "sloo": True, "search": "grid", "grid": {"var_smoothing": [1e-9, 1e-3]}, "search_rows": 60},
])
def test_training_modes(spark, settings):
    x, y = blobs(3, 40, 3)
    rows = [(i, int(c), [float(v) for v in r], i % 8, i % 5, float(i % 10), float(i // 10)) for i, (r, c) in enumerate(zip(x, y)) if c < 3 or i % 2]
    df = spark.createDataFrame(
        rows, "sample_id bigint, label int, bands array<double>, polygon_id bigint, stand_id bigint, x double, y double")
    result = train(df, **settings)
    assert result.scores().first()["overall_accuracy"] > 0.8
    if settings["split"] in ("SLOO", "STAND"):
        assert result.fold_cells.select("iter").distinct().count() == settings["max_iter"]


def test_validation_table(spark):
    x, y = blobs(3, 40, 3)
    other, truth = blobs(4, 15, 3, seed=1)
    other[0, 0] = np.nan
    result = train(samples(spark, x, y), code="NB", validation=samples(spark, other, truth), search="grid", grid={"var_smoothing": [1e-9, 1e-3]}, folds=2)
    cells = {(r.label, r.prediction): r.n for r in result.cells.collect()}
    assert sum(cells.values()) == 60 and {p for _, p in cells} <= {1, 2, 3}
    assert sum(n for (label, _), n in cells.items() if label == 4) == 15 and cells[2, 2] == 15
    with pytest.raises(ValueError):
        train(samples(spark, x, y), code="NB", validation=samples(spark, other, truth), split="SLOO", distance=1.0)


def test_spatial_search_scores_on_the_spatial_folds(spark):
    x, y = blobs(2, 30, 2)
    rows = [(i, int(c), [float(v) for v in r], i % 6) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "sample_id bigint, label int, bands array<double>, stand_id bigint")
    result = train(df, code="GMM", split="STAND", sloo=True, max_iter=4, search="grid", grid={"tau": [0.0, 0.01]}, folds=2)
    assert all(len(h["scores"]) == 4 for h in result.search.history)
    right = {r.iter: r.n for r in result.fold_cells.filter("label = prediction").groupBy("iter").agg(F.sum("n").alias("n")).collect()}
    best = result.search.best["scores"]
    assert [round(s * 10) for s in best] == [right[i] for i in range(4)]


def test_training_on_everything_assesses_nothing(spark):
    x, y = blobs(2, 10, 2)
    with pytest.raises(ValueError):
        train(samples(spark, x, y), code="NB", split=100).scores()


def test_shapley_values_add_up(spark):
    x, y = blobs(2, 60, 4, gap=0.0)
    y = np.where(x[:, 0] + x[:, 1] > 0, 2, 1)
    df = samples(spark, x, y)
    fitted = learners.fit("NB", df)
    values = explain.shapley_values(fitted, df, sample_limit=12, background_limit=15, seed=3)
    total = values.groupBy("sample_id", "class").agg(F.sum("value").alias("t"))
    p = {r["sample_id"]: r["probability"] for r in fitted.predict(df, ["sample_id"], True).collect()}
    ground = [r["sample_id"] for r in explain.draw_table(df, 15, "3|ground").collect()]
    base = np.mean([p[i] for i in ground], axis=0)
    for r in total.collect():
        assert r["t"] == pytest.approx(p[r["sample_id"]][r["class"] - 1] - base[r["class"] - 1], abs=1e-9)
    ranked = [r["band"] for r in explain.rank_features(explain.aggregate_attributions(values)).collect()]
    assert set(ranked[:2]) == {1, 2}


def test_sampled_coalitions_add_up(spark):
    x, y = blobs(2, 20, 10, gap=0.5)
    df = samples(spark, x, y)
    fitted = learners.fit("NB", df)
    values = explain.shapley_values(fitted, df, sample_limit=3, background_limit=4, permutations=3, seed=1)
    p = {r["sample_id"]: r["probability"] for r in fitted.predict(df, ["sample_id"], True).collect()}
    base = np.mean([p[r["sample_id"]] for r in explain.draw_table(df, 4, "1|ground").collect()], axis=0)
    for r in values.groupBy("sample_id", "class").agg(F.sum("value").alias("t")).collect():
        assert r["t"] == pytest.approx(p[r["sample_id"]][r["class"] - 1] - base[r["class"] - 1], abs=1e-9)


def test_streams_equal_batches(spark, tmp_path):
    x, y = blobs(3, 60, 3)
    folder = str(tmp_path / "in")
    for part in np.array_split(np.random.RandomState(0).permutation(len(x)), 6):
        samples(spark, x[part], y[part]).coalesce(1).write.mode("append").parquet(folder)
    source = spark.read.parquet(folder)
    stream = lambda: spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    seen = []
    query = streams.stream_gmm_fit(stream(), 3, lambda m, i: seen.append(m), str(tmp_path / "c1"), available_now=True)
    query.awaitTermination()
    whole = learners.fit("GMM", source)
    assert len(seen) >= 6
    assert np.allclose(seen[-1].mean, whole.model.mean) and np.allclose(seen[-1].cov, whole.model.cov, atol=1e-9)
    out = streams.stream_to_table(streams.stream_predict(stream(), whole, keep=["sample_id"]), str(tmp_path / "out"), str(tmp_path / "c2"))
    batch = whole.predict(source, ["sample_id"])
    assert out.exceptAll(batch).count() == 0 and out.count() == 180


def test_reports_round_trip(spark, tmp_path):
    path = str(tmp_path / "run")
    files = reports.write_report_tables(cells(spark, [[50, 5], [10, 3]]), path, {"split_mode": "RANDOM_SPLIT"}, {1: "wood", 2: "lake"})
    assert "trust_card.json" in files
    card = json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(f"{path}/trust_card.json").collect()))
    assert card["risk_flags"] == ["spatial_leakage_risk"] or "low_overall_accuracy" not in card["risk_flags"]
    text = [r[0] for r in spark.read.text(f"{path}/confusion_matrix_labeled.csv").collect()]
    assert text == ["true/pred,wood,lake", "wood,50,5", "lake,10,3"]
    assert [r[0] for r in spark.read.text(f"{path}/confusion_matrix_numeric.csv").collect()] == ["50,5", "10,3"]


def test_odd_report_cells_are_zero(spark, tmp_path):
    folder = tmp_path / "r1"
    folder.mkdir()
    (folder / "m.csv").write_text("Overall Accuracy,0.85\nKappa,0.7\n,1,2\n1,50,x\n2,10.9,35\n")
    got = {(r["label"], r["prediction"]): r["n"] for r in reports.load_confusion_reports(spark, str(tmp_path)).collect()}
    assert got == {("1", "1"): 50, ("1", "2"): 0, ("2", "1"): 10, ("2", "2"): 35}
    scores = {r["metric"]: r["value"] for r in reports.load_report_scores(spark, str(tmp_path)).collect()}
    assert scores == {"Overall Accuracy": 0.85, "Kappa Coefficient": 0.7}


@pytest.mark.parametrize("name,sensor,cover", [
    ("S2B_T32TQN_20200101.tif", "sentinel2", "unknown"), ("LC08_L1TP_x.tif", "landsat8", "unknown"),
    ("LC09_L1TP_x.tif", "landsat9", "unknown"), ("agriculture_data.tif", "unknown", "agriculture"),
    ("random_image.tif", "unknown", "unknown")])
def test_names_tell_sensor_and_cover(spark, name, sensor, cover):
    df = spark.createDataFrame([(name,)], "n string")
    row = df.select(scalar.detect_sensor(F.col("n")), scalar.detect_landcover(F.col("n"))).first()
    assert tuple(row) == (sensor, cover)


def test_score_levels_and_stars(spark):
    df = spark.createDataFrame([(float(v),) for v in (100, 85, 70, 45, 20, 80, 60, 40, 10)], "s double")
    rows = df.select(scalar.confidence_class(F.col("s")).alias("c"), scalar.stars(F.col("s")).alias("n")).collect()
    assert [r["c"] for r in rows[:5]] == ["Excellent match", "Good match", "Possible match", "Low confidence", "Not recommended"]
    assert [rows[i]["n"] for i in (0, 5, 6, 7, 8)] == [5, 4, 3, 2, 1]


def test_recipes_are_upgraded(spark):
    docs = ['{"name": "a", "own": [1, 2], "provenance": {"source": "web"}, "compat": 3}', "{}", "not json"]
    got = [json.loads(r[0]) for r in spark.createDataFrame([(d,) for d in docs], "d string").select(scalar.upgrade_recipe(F.col("d"))).collect()]
    assert got[0]["own"] == [1, 2] and got[0]["provenance"] == {"source": "web"} and got[0]["compat"]["min_plugin_version"] == ""
    for g in got:
        assert g["schema_version"] == 2 and g["version"] == 1 and g["constraints"]["requires_gpu"] is False
        assert g["expected_accuracy_class"] == "high"


def test_label_text(spark):
    df = spark.createDataFrame([("1:Forest, 2 : Water;;bad,:x,3:\n1:Wood:land",)], "t string")
    assert df.select(scalar.parse_label_map(F.col("t"))).first()[0] == {"2": "Water", "1": "Wood:land"}


def test_tiles_are_written_for_pruning(spark, grid, tmp_path):
    tables.write_tiles(grid, str(tmp_path / "t"), 32, 32)
    back = spark.read.parquet(str(tmp_path / "t")).filter("tile_row = 1")
    assert back.count() == 28 * 80
    assert "PartitionFilters: [isnotnull(tile_row" in back._jdf.queryExecution().toString()


def test_shared_folder_is_required_on_a_cluster(spark):
    from bandloom import session

    class Remote:
        class conf:
            @staticmethod
            def get(key, default=None):
                return None

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError):
        session.shared_dir(Remote)
    assert session.cut_lineage(spark.range(5)).count() == 5


@pytest.mark.parametrize("settings", [
    {"polygon_groups": True, "search": "grid", "grid": {"tau": [0.0, 0.1]}, "folds": 2},
    {"split": "STAND", "max_iter": 2},
    {"split": "SLOO", "distance": 1.5, "max_iter": 2},
])
def test_train_oversamples_beside_places(spark, settings):
    x, y = blobs(2, 40, 2, gap=3.0)
    keep = [i for i in range(len(y)) if y[i] == 1 or i % 4 == 0]
    rows = [(i, int(y[i]), [float(v) for v in x[i]], i // 4, i // 8, float(i % 10), float(i // 10)) for i in keep]
    df = spark.createDataFrame(rows, "sample_id int, label int, bands array<double>, polygon_id int, stand_id int, x double, y double")
    assert train(df, code="GMM", use_smote=True, **settings).scores().first()["overall_accuracy"] > 0.8
    made = oversample.smote(df, seed=1).filter("synthetic")
    seeds = df.selectExpr("cast(sample_id as string) as seed", "polygon_id as p", "stand_id as s", "x as sx")
    joined = made.withColumn("seed", F.substring_index("sample_id", "#", 1)).join(seeds, "seed")
    assert joined.count() == made.count() > 0 and joined.filter("polygon_id <> p or stand_id <> s or x <> sx").count() == 0


def test_search_uses_all_rows_unless_told_otherwise(spark, monkeypatch):
    from bandloom.plans import train as plan

    seen = []

    def search(code, rows, grid, k, *args, **kwargs):
        seen.append((rows.count(), grid, k, kwargs["fast"]))
        return tuning.Search(code, [{"place": 0, "params": {}, "mean": 1.0, "std": 0.0, "scores": [1.0], "state": "complete"}])

    monkeypatch.setattr(plan.tuning, "grid_search", search)
    df = spark.range(21_000).selectExpr("id as sample_id", "cast(1 + id % 2 as int) as label", "array(double(id % 7), double(id % 11)) as bands")
    grid = {"tau": [0.0, 0.1, 1.0]}
    train(df, code="GMM", split=100, search="grid", grid=grid, folds=4)
    train(df, code="GMM", split=100, search="grid", grid=grid, folds=4, search_rows=500)
    assert seen[0] == (21_000, grid, 4, False)
    assert 490 <= seen[1][0] <= 510 and seen[1][1:] == seen[0][1:]


def test_what_cannot_be_done_is_refused(spark):
    x, y = blobs(2, 20, 3)
    df = samples(spark, x, y)
    scaler = prepare.fit_scaler(df)
    narrow = df.withColumn("bands", F.slice("bands", 1, 2))
    with pytest.raises(Exception, match="bounds of 3 bands"):
        scaler.transform(narrow).collect()
    with pytest.raises(ValueError, match="depth"):
        learners.fit("RF", df, {"max_depth": 99})
    with pytest.raises(ValueError, match="permutations"):
        explain.coalitions(64)
    for code, params in (("RF", {"min_samples_split": 200, "n_estimators": 2}), ("LR", {"solver": "saga", "max_iter": 2}), ("MLP", {"learning_rate_init": 0.5, "max_iter": 2, "solver": "lbfgs"})):
        with pytest.warns(UserWarning, match="ignored"):
            learners.fit(code, df, params)
