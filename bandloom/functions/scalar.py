"""Column functions: labels, file names, recipes, scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from bandloom import fixed_values as fv


def label_entries(text: Column) -> Column:
    """`code:name` tokens of a label text as an array of (code, name) structs.

    Tokens are separated by new lines, `;` or `,`; the first `:` splits a token.
    Tokens without a code, a name or a colon are skipped.
    """
    tokens = F.filter(F.split(text, "[\n;,]"), lambda t: t.contains(":"))
    pairs = F.transform(
        tokens,
        lambda t: F.struct(
            F.trim(F.substring_index(t, ":", 1)).alias("code"),
            F.trim(F.regexp_replace(t, "^[^:]*:", "")).alias("name"),
        ),
    )
    return F.filter(pairs, lambda p: (p["code"] != "") & (p["name"] != ""))


def parse_label_map(text: Column) -> Column:
    """Label text as map code -> name; the last token of a code wins."""
    pairs = label_entries(text)
    codes = F.transform(pairs, lambda p: p["code"])
    kept = F.filter(
        pairs,
        lambda p, i: ~F.array_contains(F.slice(codes, i + 2, F.greatest(F.size(codes) - i - 1, F.lit(0))), p["code"]),
    )
    return F.map_from_entries(kept)


def normalize_class_key(value: Column) -> Column:
    """Whole numbers as integer text, everything else as it is."""
    text = value.cast("string")
    number = text.try_cast("double")
    whole = number.isNotNull() & (number == F.floor(number)) & (F.abs(number) < F.lit(9.0e18))
    return F.when(whole, number.try_cast("bigint").cast("string")).otherwise(text)


def argmax_position(scores: Column) -> Column:
    """0-based position of the first largest element."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def first_match(name: Column, patterns: dict[str, Sequence[str]], default: str = "unknown") -> Column:
    """Key of the first pattern list with a case-insensitive hit in `name`."""
    out = None
    for key, alternatives in patterns.items():
        hit = name.rlike("(?i)(" + "|".join(alternatives) + ")")
        out = F.when(hit, F.lit(key)) if out is None else out.when(hit, F.lit(key))
    return out.otherwise(F.lit(default))


def detect_sensor(name: Column) -> Column:
    return first_match(name, fv.SENSOR_PATTERNS)


def detect_landcover(name: Column) -> Column:
    return first_match(name, fv.LANDCOVER_PATTERNS)


def filename_hints(name: Column) -> Column:
    """Keywords found in a file name, plus hints from coded sensor names."""
    low = F.lower(name)
    words = F.filter(F.array(*[F.lit(k) for k in fv.HINT_KEYWORDS]), lambda k: low.contains(k))

    def any_of(codes):
        out = F.lit(False)
        for code in codes:
            out = out | low.contains(code)
        return out

    landsat = F.when(~low.contains("landsat") & any_of(fv.LANDSAT_CODES), F.array(F.lit("landsat")))
    sentinel = F.when(~low.contains("sentinel") & low.contains(fv.SENTINEL_CODE), F.array(F.lit("sentinel")))
    none = F.array().cast("array<string>")
    return F.concat(words, F.coalesce(landsat, none), F.coalesce(sentinel, none))


def confidence_class(score: Column) -> Column:
    out = None
    for bound, text in fv.SCORE_LEVELS:
        out = F.when(score >= bound, F.lit(text)) if out is None else out.when(score >= bound, F.lit(text))
    return out.otherwise(F.lit(fv.SCORE_LOWEST))


def stars(score: Column) -> Column:
    """1 to 5; half-even rounding of score / 20."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.bround(score / 20.0, 0).cast("int")))


def base_name(path: Column) -> Column:
    """Last path element without its extension."""
    tail = F.regexp_extract(path, "([^/]*)$", 1)
    return F.regexp_replace(tail, r"(?<=.)\.[^.]*$", "")


def output_name(path: Column, code: Column) -> Column:
    clean = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    clean = F.when(clean == "", F.lit(fv.DEFAULT_CODE)).otherwise(clean)
    label = clean
    for short, spelled in fv.CODE_LABELS.items():
        label = F.when(clean == short, F.lit(spelled)).otherwise(label)
    return F.concat(base_name(path), F.lit("_"), label, F.lit(".tif"))


def classified_path(path: Column) -> Column:
    """`classified_<name>` beside the input."""
    folder = F.regexp_extract(path, "^(.*/)?[^/]*$", 1)
    return F.concat(folder, F.lit(fv.OUTPUT_PREFIX), F.regexp_extract(path, "([^/]*)$", 1))


def mask_path(path: Column) -> Column:
    """The mask companion: `<name>_mask.<ext>` beside the input."""
    return F.regexp_replace(path, r"^(.*?)(\.[^./]*)?$", "$1" + fv.MASK_SUFFIX + "$2")


def bind(value: Column, use) -> Column:
    """`use(value)` with the value computed once per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def softmax(logits: Column) -> Column:
    """Softmax of an array column, shifted by its largest element."""
    limit = 709.782712893384
    bounded = F.transform(logits, lambda v: F.greatest(F.lit(-limit), F.least(F.lit(limit), v)))

    def powers(b: Column) -> Column:
        return bind(F.array_max(b), lambda top: F.transform(b, lambda v: F.exp(v - top)))

    def shares(p: Column) -> Column:
        return bind(F.aggregate(p, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(p, lambda v: v / total))

    return bind(bind(bounded, powers), shares)


def upgrade_recipe(document: Column) -> Column:
    """A recipe document (JSON text) raised to schema version 2.

    Legacy keys stay; sections that are missing or not objects become defaults.
    """
    entries = F.coalesce(
        F.try_parse_json(document).try_cast("map<string,variant>"),
        F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")),
    )

    def default(text: str) -> Column:
        return F.parse_json(F.lit(text))

    def is_object(value: Column) -> Column:
        return F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))

    added = {
        "version": F.coalesce(
            F.try_variant_get(entries["version"], "$", "bigint"), F.lit(fv.RECIPE_LEGACY_VERSION).cast("bigint")
        ).cast("variant"),
        "schema_version": F.lit(fv.RECIPE_SCHEMA_VERSION).cast("bigint").cast("variant"),
    }
    for name, text in fv.RECIPE_SECTIONS.items():
        added[name] = F.when(is_object(entries[name]), entries[name]).otherwise(default(text))
    for name, text in fv.RECIPE_TEXT_DEFAULTS.items():
        added[name] = F.coalesce(entries[name], F.lit(text).cast("variant"))
    kept = F.map_filter(entries, lambda k, v: ~k.isin(*added.keys()))
    extra = F.map_from_arrays(F.array(*[F.lit(k) for k in added]), F.array(*added.values()))
    return F.to_json(F.map_concat(kept, extra))


def recipe_tags(flags: Column, nested_in_validation: Column) -> Column:
    """Feature tags from a map of recipe flags."""
    last = fv.RECIPE_TAGS[-1][0]
    picks = []
    for flag, tag in fv.RECIPE_TAGS:
        on = F.coalesce(flags[flag], F.lit(False))
        if flag == last:
            on = on | F.coalesce(nested_in_validation, F.lit(False))
        picks.append(F.when(on, F.lit(tag)))
    return F.array_compact(F.array(*picks))


def score_recipe(raster: dict[str, Column], recipe: dict[str, Column]) -> Column:
    """Fit of a recipe for a raster, 30 to 100.

    raster: sensor, bands, size_mb, landcover, hints.
    recipe: name, description, classifier, smote (flag), shap (flag).
    """
    name, text = F.lower(recipe["name"]), F.lower(recipe["description"])
    sensor, bands, hints = raster["sensor"], raster["bands"], raster["hints"]

    def points(condition: Column, value: float) -> Column:
        return F.when(condition, F.lit(float(value))).otherwise(F.lit(0.0))

    def mentions(word: str) -> Column:
        return name.contains(word) | text.contains(word)

    sentinel = (sensor == "sentinel2") | F.array_contains(hints, "sentinel")
    landsat = sensor.isin("landsat8", "landsat9") | F.array_contains(hints, "landsat")
    by_sensor = (
        F.when(
            sentinel,
            F.when(bands.between(10, 13), 40.0).when(bands.between(4, 10), 25.0).otherwise(0.0)
            + points(mentions("sentinel"), 20),
        )
        .when(
            landsat,
            F.when(bands.between(7, 11), 40.0).when(bands.between(4, 7), 25.0).otherwise(0.0)
            + points(mentions("landsat"), 20),
        )
        .when(bands > 20, 30.0 + points(name.contains("feature") | name.contains("selection"), 15))
        .when(bands.isin(3, 4), 20.0)
        .otherwise(0.0)
    )
    fast = recipe["classifier"].isin(*fv.FAST_CLASSIFIERS)
    slow = recipe["classifier"].isin(*fv.SLOW_CLASSIFIERS)
    by_size = (
        F.when(raster["size_mb"] > 1000, points(fast, 15) - points(slow, 20))
        .when(raster["size_mb"] > 500, points(fast, 8))
        .otherwise(0.0)
    )
    by_cover = F.lit(0.0)
    for cover, words in fv.LANDCOVER_RECIPE_WORDS.items():
        hit = F.lit(False)
        for word in words:
            hit = hit | mentions(word)
        by_cover = F.when((raster["landcover"] == cover) & hit, 15.0).otherwise(by_cover)
    total = (
        F.lit(30.0)
        + by_sensor
        + by_size
        + by_cover
        + points(recipe["smote"] | name.contains("imbalanced"), 5)
        + points(name.contains("fast") | name.contains("quick"), 5)
        + points(name.contains("accuracy") | name.contains("best"), 8)
        + points(recipe["shap"] | name.contains("explain"), 5)
    )
    return F.least(total, F.lit(100.0))
