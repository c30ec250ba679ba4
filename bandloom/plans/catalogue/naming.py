"""Queries on label texts, file names, recipes and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from bandloom import fixed_values as fv
from bandloom.functions import scalar
from bandloom.operators import recipes
from bandloom.plans import inputs as inp
from bandloom.plans.registry import query

R6 = lambda c: F.round(c, 6)

# Scene names are built from page addresses: a coded prefix by page number, then the host.
PREFIXES = [
    "S2B_T32TQN_", "LC08_L1TP_", "lc09_", "Planet_", "MOD09A1_", "spot-5_", "crop_field_", "Sentinel-2_",
    "landsat_8_", "forest_water_", "Urban_ndvi_", "marsh_rgb_", "x_B4.tif_", "plain_",
]


def scenes(spark, sf):
    pick = F.element_at(F.array(*[F.lit(p) for p in PREFIXES]), (F.col("page_id") % len(PREFIXES) + 1).cast("int"))
    host = F.regexp_extract("url", "//([^/]+)", 1)
    return inp.table(spark, sf, "pages").select(
        "page_id",
        F.concat(pick, host, F.lit(".tif")).alias("name"),
        F.concat(F.lit("/data/"), pick, F.lit("/"), host, F.lit(".tif")).alias("path"),
        (F.col("page_id") % 29 + 1).cast("int").alias("bands"),
        (F.length("html") * (F.col("page_id") % 5) / 8.0).alias("size_mb"),
    )


SCENES = f"""
  SELECT page_id, ({PREFIXES})[page_id % {len(PREFIXES)} + 1] || regexp_extract(url, '//([^/]+)', 1) || '.tif' AS name,
   '/data/' || ({PREFIXES})[page_id % {len(PREFIXES)} + 1] || '/' || regexp_extract(url, '//([^/]+)', 1) || '.tif' AS path,
   CAST(page_id % 29 + 1 AS INTEGER) AS bands, length(html) * (page_id % 5) / 8e0 AS size_mb
  FROM pages"""


def when_sql(patterns, column="lower(name)"):
    arms = " ".join(
        f"WHEN {' OR '.join(f'regexp_matches({column}, {chr(39)}{p}{chr(39)})' for p in alts)} THEN '{key}'"
        for key, alts in patterns.items())
    return f"CASE {arms} ELSE 'unknown' END"


LANDSAT_SQL = " OR ".join(f"contains(low, '{c}')" for c in fv.LANDSAT_CODES)
HINTS = f"""
  SELECT *, list_filter({fv.HINT_KEYWORDS}, lambda k: contains(low, k))
   || CASE WHEN NOT contains(low, 'landsat') AND ({LANDSAT_SQL}) THEN ['landsat'] ELSE [] END
   || CASE WHEN NOT contains(low, 'sentinel') AND contains(low, 's2') THEN ['sentinel'] ELSE [] END AS hints
  FROM (SELECT *, lower(name) AS low, {when_sql(fv.SENSOR_PATTERNS)} AS sensor,
        {when_sql(fv.LANDCOVER_PATTERNS)} AS landcover FROM ({SCENES}))"""


@query("h1_parse_label_map", """
WITH t AS (SELECT p_partkey, (p_partkey % 5) || ': ' || p_name || ' ; ' || (p_size % 5) || ':' || p_brand || ':x' || chr(10) || ' ,no colon, :none,9: ,' || p_type || ':' || p_size AS txt FROM part),
k AS (SELECT p_partkey, i, trim(split_part(tok, ':', 1)) AS code, trim(tok[instr(tok, ':') + 1:]) AS name
  FROM (SELECT p_partkey, unnest(string_split_regex(txt, '[\n;,]')) AS tok, generate_subscripts(string_split_regex(txt, '[\n;,]'), 1) AS i FROM t) WHERE contains(tok, ':'))
SELECT p_partkey, code, arg_max(name, i) AS name FROM k WHERE code <> '' AND name <> '' GROUP BY 1, 2""")
def parse_label_map(spark, sf):
    text = F.concat(
        (F.col("p_partkey") % 5).cast("string"), F.lit(": "), "p_name", F.lit(" ; "), (F.col("p_size") % 5).cast("string"),
        F.lit(":"), "p_brand", F.lit(":x\n ,no colon, :none,9: ,"), "p_type", F.lit(":"), F.col("p_size").cast("string"))
    return inp.table(spark, sf, "part").select("p_partkey", F.explode(scalar.parse_label_map(text)).alias("code", "name"))


@query("h3_detect_sensor", f"""
WITH s AS ({SCENES}) SELECT page_id, name, {when_sql(fv.SENSOR_PATTERNS)} AS sensor FROM s""")
def detect_sensor(spark, sf):
    return scenes(spark, sf).select("page_id", "name", scalar.detect_sensor(F.col("name")).alias("sensor"))


@query("h4_detect_landcover", f"""
WITH s AS ({SCENES}) SELECT page_id, {when_sql(fv.LANDCOVER_PATTERNS)} AS landcover FROM s""")
def detect_landcover(spark, sf):
    return scenes(spark, sf).select("page_id", scalar.detect_landcover(F.col("name")).alias("landcover"))


@query("h5_filename_hints", f"""
WITH h AS ({HINTS}) SELECT page_id, array_to_string(hints, ',') AS hints FROM h""")
def filename_hints(spark, sf):
    return scenes(spark, sf).select("page_id", F.concat_ws(",", scalar.filename_hints(F.col("name"))).alias("hints"))


RECIPES = [
    ("Fast baseline", "Quick random forest for any image", "RF", False, False),
    ("Sentinel best accuracy", "Gradient boosting for Sentinel scenes", "XGB", False, True),
    ("Landsat crop mapping", "Crop and farm maps from Landsat", "SVM", True, False),
    ("Feature selection", "Many bands, vegetation indices", "ET", False, True),
    ("Imbalanced urban", "Built-up areas with few samples", "MLP", True, False),
    ("Explainable water", "Aquatic classes with attributions", "LR", False, False),
]


def sql_recipes():
    rows = ", ".join(
        f"('{n.lower()}', '{t.lower()}', '{c}', {str(sm).lower()}, {str(sh).lower()})" for n, t, c, sm, sh in RECIPES)
    return f"(VALUES {rows}) AS r(rn, rt, code, smote, shap)"


def mention(word):
    return f"(contains(rn, '{word}') OR contains(rt, '{word}'))"


COVER_SQL = " ".join(
    f"WHEN landcover = '{c}' AND ({' OR '.join(mention(w) for w in words)}) THEN 15" for c, words in fv.LANDCOVER_RECIPE_WORDS.items())
SCORES = f"""
 SELECT page_id, rn AS recipe, CAST(least(100, 30
  + CASE WHEN sensor = 'sentinel2' OR list_contains(hints, 'sentinel') THEN
      CASE WHEN bands BETWEEN 10 AND 13 THEN 40 WHEN bands BETWEEN 4 AND 10 THEN 25 ELSE 0 END + CASE WHEN {mention('sentinel')} THEN 20 ELSE 0 END
    WHEN sensor IN ('landsat8', 'landsat9') OR list_contains(hints, 'landsat') THEN
      CASE WHEN bands BETWEEN 7 AND 11 THEN 40 WHEN bands BETWEEN 4 AND 7 THEN 25 ELSE 0 END + CASE WHEN {mention('landsat')} THEN 20 ELSE 0 END
    WHEN bands > 20 THEN 30 + CASE WHEN contains(rn, 'feature') OR contains(rn, 'selection') THEN 15 ELSE 0 END
    WHEN bands IN (3, 4) THEN 20 ELSE 0 END
  + CASE WHEN size_mb > 1000 THEN CASE WHEN code IN ('RF', 'ET', 'XGB') THEN 15 WHEN code IN ('SVM', 'MLP') THEN -20 ELSE 0 END
         WHEN size_mb > 500 THEN CASE WHEN code IN ('RF', 'ET', 'XGB') THEN 8 ELSE 0 END ELSE 0 END
  + CASE {COVER_SQL} ELSE 0 END
  + CASE WHEN smote OR contains(rn, 'imbalanced') THEN 5 ELSE 0 END
  + CASE WHEN contains(rn, 'fast') OR contains(rn, 'quick') THEN 5 ELSE 0 END
  + CASE WHEN contains(rn, 'accuracy') OR contains(rn, 'best') THEN 8 ELSE 0 END
  + CASE WHEN shap OR contains(rn, 'explain') THEN 5 ELSE 0 END) AS DOUBLE) AS score
 FROM ({HINTS}) CROSS JOIN {sql_recipes()}"""


def scored_scenes(spark, sf):
    table = spark.createDataFrame(RECIPES, "name string, description string, classifier string, smote boolean, shap boolean")
    return recipes.recommend_recipes(recipes.describe_rasters(scenes(spark, sf)), table)


@query("h6_score_recipe", f"WITH s AS ({SCORES}) SELECT page_id, recipe, score FROM s WHERE score > 0")
def score_recipe(spark, sf):
    return scored_scenes(spark, sf).select("page_id", F.lower("recipe").alias("recipe"), "score")


@query("f4_recommend_recipes", f"""
WITH s AS ({SCORES}), r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, recipe) AS place FROM s WHERE score > 0)
SELECT page_id, recipe, score, CAST(place AS INTEGER) AS place FROM r""")
def recommend_recipes(spark, sf):
    return recipes.rank_recommendations(scored_scenes(spark, sf).withColumn("recipe", F.lower("recipe")), ["page_id"]).select(
        "page_id", "recipe", "score", "place")


@query("h7_confidence_class", """
SELECT p_partkey, CASE WHEN p_size * 2 >= 95 THEN 'Excellent match' WHEN p_size * 2 >= 80 THEN 'Good match' WHEN p_size * 2 >= 60 THEN 'Possible match'
  WHEN p_size * 2 >= 40 THEN 'Low confidence' ELSE 'Not recommended' END AS level,
  CAST(greatest(1, least(5, round_even(p_size * 2 / 20e0, 0))) AS INTEGER) AS stars FROM part""")
def confidence_class(spark, sf):
    score = F.col("p_size") * 2.0
    return inp.table(spark, sf, "part").select(
        "p_partkey", scalar.confidence_class(score).alias("level"), scalar.stars(score).alias("stars"))


@query("h8_output_name", f"""
WITH s AS ({SCENES}), c AS (SELECT *, CASE page_id % 4 WHEN 0 THEN 'xgb' WHEN 1 THEN ' CB ' WHEN 2 THEN '' ELSE 'rf' END AS code,
  regexp_extract(path, '([^/]*)$', 1) AS tail FROM s)
SELECT page_id, regexp_replace(tail, '\\.[^.]*$', '') || CASE page_id % 4 WHEN 0 THEN '_XGBoost' WHEN 1 THEN '_CatBoost' WHEN 2 THEN '_CLASS' ELSE '_RF' END || '.tif' AS output,
 left(path, length(path) - length(tail)) || 'classified_' || tail AS classified,
 regexp_replace(path, '\\.tif$', '_mask.tif') AS mask FROM c""")
def output_name(spark, sf):
    k = F.col("page_id") % 4
    code = F.when(k == 0, "xgb").when(k == 1, " CB ").when(k == 2, "").otherwise("rf")
    path = F.col("path")
    return scenes(spark, sf).select(
        "page_id", scalar.output_name(path, code).alias("output"), scalar.classified_path(path).alias("classified"),
        scalar.mask_path(path).alias("mask"))


@query("h9_upgrade_recipe", """
SELECT p_partkey, p_name AS name, CAST(CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE 1 END AS BIGINT) AS version, CAST(2 AS BIGINT) AS schema_version,
 CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'local' END AS source, CASE WHEN p_partkey % 5 = 0 THEN 'slow' ELSE 'medium' END AS runtime,
 'high' AS accuracy, true AS offline, '' AS signature FROM part""")
def upgrade_recipe(spark, sf):
    k = F.col("p_partkey")
    doc = F.concat(
        F.lit('{"name":"'), "p_name", F.lit('"'),
        F.when(k % 2 == 0, F.concat(F.lit(',"version":'), F.col("p_size").cast("string"))).otherwise(F.lit("")),
        F.when(k % 3 == 0, F.concat(F.lit(',"provenance":{"source":"'), "p_brand", F.lit('"}'))).when(
            k % 3 == 1, F.lit(',"provenance":"none"')).otherwise(F.lit("")),
        F.when(k % 5 == 0, F.lit(',"expected_runtime_class":"slow"')).otherwise(F.lit("")), F.lit("}"))
    up = inp.table(spark, sf, "part").select("p_partkey", scalar.upgrade_recipe(doc).alias("d"))
    get = lambda p, t="string": F.get_json_object("d", p).cast(t)
    return up.select(
        "p_partkey", get("$.name").alias("name"), get("$.version", "bigint").alias("version"),
        get("$.schema_version", "bigint").alias("schema_version"), get("$.provenance.source").alias("source"),
        get("$.expected_runtime_class").alias("runtime"), get("$.expected_accuracy_class").alias("accuracy"),
        get("$.constraints.offline_compatible", "boolean").alias("offline"), get("$.signature").alias("signature"))


@query("h10_recipe_tags", """
SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size % 2 = 0 THEN 'Optuna' END, CASE WHEN p_size % 3 = 0 THEN 'SHAP' END,
  CASE WHEN p_size % 5 = 0 THEN 'SMOTE' END, CASE WHEN p_size % 7 = 0 THEN 'Class weights' END,
  CASE WHEN p_size % 11 = 0 OR p_partkey % 13 = 0 THEN 'Nested CV' END], lambda t: t IS NOT NULL), ',') AS tags FROM part""")
def recipe_tags(spark, sf):
    s = F.col("p_size")
    flags = F.create_map(
        F.lit("USE_OPTUNA"), s % 2 == 0, F.lit("COMPUTE_SHAP"), s % 3 == 0, F.lit("USE_SMOTE"), s % 5 == 0,
        F.lit("USE_CLASS_WEIGHTS"), s % 7 == 0, F.lit("USE_NESTED_CV"), s % 11 == 0)
    return inp.table(spark, sf, "part").select(
        "p_partkey", F.concat_ws(",", scalar.recipe_tags(flags, F.col("p_partkey") % 13 == 0)).alias("tags"))


@query("h11_softmax_logits", f"""
WITH s AS ({inp.LINE}), k AS (SELECT sample_id, -b1 / 2 AS a, -b2 / 2000 AS b, -b3 * 50 AS c FROM s), m AS (SELECT *, greatest(a, b, c) AS t FROM k),
e AS (SELECT sample_id, exp(a - t) AS x, exp(b - t) AS y, exp(c - t) AS z FROM m)
SELECT sample_id, round(x / (x + y + z), 6) AS p1, round(y / (x + y + z), 6) AS p2, round(z / (x + y + z), 6) AS p3 FROM e""")
def softmax_logits(spark, sf):
    b = F.col("bands")
    p = inp.line_samples(spark, sf).select("sample_id", scalar.softmax(F.array(-b[0] / 2, -b[1] / 2000, -b[2] * 50)).alias("p"))
    return p.select("sample_id", *[R6(F.col("p")[i]).alias(f"p{i + 1}") for i in range(3)])


def part_recipes(spark, sf):
    """part as a recipe catalogue: names, runtime and accuracy classes."""
    k = F.col("p_partkey")
    return inp.table(spark, sf, "part").select(
        k.alias("recipe_id"), F.concat("p_name", F.lit(" "), k.cast("string")).alias("name"), (k % 3 == 0).alias("builtin"),
        F.element_at(F.array(*[F.lit(v) for v in ("fast", "medium", "slow", "")]), (F.col("p_size") % 4 + 1).cast("int")).alias("runtime"),
        F.element_at(F.array(*[F.lit(v) for v in ("very_high", "high", "medium", "low", "baseline", "")]), (k % 6 + 1).cast("int")).alias("accuracy"))


RANKS = """
 SELECT p_partkey AS recipe_id, lower(p_name || ' ' || p_partkey) AS name, p_partkey % 3 = 0 AS builtin,
  CASE p_size % 4 WHEN 0 THEN 1 WHEN 2 THEN 3 ELSE 2 END AS rr, CASE p_partkey % 6 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 ELSE 2 END AS ar
 FROM part"""


@query("f3_rank_recipes", f"""
WITH r AS ({RANKS}) SELECT recipe_id, row_number() OVER (ORDER BY CASE WHEN builtin THEN 0 ELSE 1 END, rr, -ar, name) AS place FROM r""")
def rank_recipes(spark, sf):
    return recipes.rank_recipes(part_recipes(spark, sf), "default").select("recipe_id", F.col("place").cast("bigint").alias("place"))


@query("f3_preset_recipes", f"""
WITH r AS ({RANKS}) SELECT recipe_id, 'FAST' AS preset FROM r WHERE rr = (SELECT min(rr) FROM r)
UNION ALL SELECT recipe_id, 'QUALITY' FROM r WHERE ar = (SELECT max(ar) FROM r)""")
def preset_recipes(spark, sf):
    table = part_recipes(spark, sf)
    return recipes.preset(table, "FAST").select("recipe_id", F.lit("FAST").alias("preset")).unionByName(
        recipes.preset(table, "QUALITY").select("recipe_id", F.lit("QUALITY").alias("preset")))
