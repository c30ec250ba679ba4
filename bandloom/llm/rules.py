"""Quality rules: base counts, and divergence from language references, natively."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bandloom.llm.words import SPACES, bind, word_array
from bandloom.session import cut_lineage

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Character classes, taken out of the text one after the other; what is left is the last class.
CLASSES = {"lower": "[a-z]+", "space": SPACES, "upper": "[A-Z]+", "mark": "[.,;:!?'\"()\\-]+", "digit": "[0-9]+", "beyond": "[^\\x00-\\x7F]+"}
COMMON_WORDS = 20
# Jensen-Shannon distances (0 to 1) above which a text is not of its language, and the
# counts a histogram needs before it is trusted.
MAX_CLASS_DISTANCE = 0.3
MAX_WORD_DISTANCE = 0.43
MIN_CLASS_CHARS = 200
MIN_HISTOGRAM_WORDS = 50
# More languages than this are joined by a shuffle instead of a broadcast.
LANGUAGES = 10_000


def dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.regexp_replace(x, SPACES, "") != "")
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that stand twice or more in the text.

    Window hashes, their low bits replaced by the position, are sorted; neighbours
    with equal hashes are confirmed word by word. No pair of distant windows is
    compared, so a long text costs its length times the logarithm of it.
    """
    last = F.size(words) - 3
    at = lambda i: F.get(words, i)
    zero = F.lit(0).cast("bigint")

    def positions(step: Column) -> Column:
        """Of windows with an equal one; `step` is the power of two above all positions."""
        keep = F.bitwise_not(step - 1).bitwiseAND(F.lit((1 << 63) - 1))
        return bind(keep, lambda high: bind(
            F.sort_array(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)).bitwiseAND(high) + i)),
            lambda order: equal_neighbours(order, high, step),
        ))

    def equal_neighbours(order: Column, high: Column, step: Column) -> Column:
        met = F.filter(F.sequence(F.lit(0), last), lambda k: F.coalesce(F.get(order, k).bitwiseXOR(F.get(order, k + 1)) < step, F.lit(False)))
        low = F.bitwise_not(high).bitwiseAND(F.lit((1 << 63) - 1))
        place = lambda k: F.get(order, k).bitwiseAND(low).cast("int")

        def confirmed(k):
            i, j = place(k), place(k + 1)
            same = (at(i) == at(j)) & (at(i + 1) == at(j + 1)) & (at(i + 2) == at(j + 2))
            return F.when(same, F.array(i, j)).otherwise(F.array().cast("array<int>"))

        return F.sort_array(F.array_distinct(F.flatten(F.transform(met, confirmed))))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(places, k + 1) - x, F.lit(3))))
        return F.aggregate(gaps, zero, lambda a, x: a + x)

    step = F.pow(F.lit(2.0), F.ceil(F.log2(F.size(words) + F.lit(1.0)))).cast("bigint")
    return F.when(last < 1, zero).otherwise(bind(bind(step, positions), covered))


def class_counts(text: Column) -> Column:
    """Array of character counts by CLASSES and one for the rest; each class shortens what the next reads."""
    counts, rest = [], F.coalesce(text, F.lit(""))

    def step(rest: Column, left: list[str]) -> Column:
        size = F.length(rest).cast("bigint")
        if not left:
            return F.array(size)
        return bind(F.regexp_replace(rest, left[0], ""), lambda shorter: F.concat(F.array(size - F.length(shorter)), step(shorter, left[1:])))

    return step(rest, list(CLASSES.values()))


def word_bins(words: Column, common: Column) -> Column:
    """Array of counts: per common word how often it stands in `words` (lower case), then all other words."""
    # Most words are longer than every common one, and are not looked up; lower case never shortens a word.
    longest = F.array_max(F.transform(common, lambda w: F.length(w)))
    places = bind(longest, lambda most: F.filter(
        F.transform(F.filter(words, lambda w: F.length(w) <= most), lambda w: F.array_position(common, F.lower(w))), lambda p: p > 0
    ))
    counts = bind(places, lambda found: F.transform(
        common, lambda _, k: (F.size(found) - F.size(F.array_remove(found, (k + 1).cast("bigint")))).cast("bigint")
    ))
    return bind(counts, lambda c: F.array_append(c, F.size(words).cast("bigint") - _total(c)))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, x: a + x)


def js_distance(counts: Column, reference: Column) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of two histograms of one length."""
    own, other = _total(counts), _total(reference)

    def part(p, m):
        return F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))

    def term(x, y):
        p, q = x / own, y / other
        m = (p + q) / 2
        return part(p, m) + part(q, m)

    terms = F.zip_with(counts, reference, term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def language_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common_words: int = COMMON_WORDS) -> DataFrame:
    """Rows (lang, class_reference, common, word_reference) from all documents of each language.

    The common words are the most frequent lower-case words, ties by code point.
    Words are counted with partial sums; only the counts are shuffled.
    """
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang")
    classes = docs.select(lang, class_counts(F.col(text_col)).alias("c"))
    n = len(CLASSES) + 1
    classes = classes.groupBy("lang").agg(F.array(*[F.sum(F.get("c", F.lit(i))) for i in range(n)]).alias("class_reference"))
    counted = docs.select(lang, F.explode(word_array(F.col(text_col))).alias("w")).select("lang", F.lower("w").alias("word"))
    counted = counted.groupBy("lang", "word").agg(F.count("*").alias("n"))
    # Two rounds of ranks, so that a language with most words is not ordered in one task.
    counted = counted.withColumn("part", F.pmod(F.xxhash64("word"), F.lit(64)))
    by = [F.desc("n"), F.asc("word")]
    top = counted.withColumn("at", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*by))).filter(F.col("at") <= common_words)
    top = top.withColumn("at", F.row_number().over(Window.partitionBy("lang").orderBy(*by))).filter(F.col("at") <= common_words)
    listed = top.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("at", "word", "n"))).alias("top"))
    words = counted.groupBy("lang").agg(F.sum("n").alias("all")).join(listed, "lang")
    words = words.select(
        "lang", F.col("top.word").alias("common"), F.array_append(F.col("top.n"), F.col("all") - _total(F.col("top.n"))).alias("word_reference")
    )
    return classes.join(words, "lang", "left")


def judge_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    max_class_distance: float = MAX_CLASS_DISTANCE,
    max_word_distance: float = MAX_WORD_DISTANCE,
    out: str = "verdict",
) -> DataFrame:
    """The rows of `docs` with a struct `out`: the base counts, distances, base_failed, kept.

    Base rules reject texts of under MIN_WORDS words or with more than half of their
    words in repeated 3-word windows. The others are rejected when their characters or
    words are too far from the language's reference, built from all documents of the
    language; a histogram below its minimum length is not judged. Null and empty texts
    have no words and fail. A null language is a language of its own. Repeated rows
    are judged alike, an empty table gives no rows, other columns are kept as they are
    (only one that has the name of `out` is replaced).
    """
    spark = docs.sparkSession
    references = cut_lineage(language_references(docs, text_col, lang_col), "references")
    few = references.limit(LANGUAGES + 1).collect()
    if len(few) <= LANGUAGES:
        references = F.broadcast(spark.createDataFrame(few, references.schema))
    references = references.select(F.col("lang").alias("_lang"), "class_reference", "common", "word_reference")
    references = references.select("_lang", F.struct("class_reference", "common", "word_reference").alias("_reference"))
    rows = docs.select(
        F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("_lang")
    )
    text = F.col("text")
    marked = rows.withColumn("_words", word_array(text)).join(references, "_lang", "left")
    ref = F.col("_reference")
    counts = F.struct(
        F.size("_words").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, "")).cast("bigint").alias("word_chars"),
        (F.length(F.coalesce(text, F.lit(""))) - F.length(F.translate(F.coalesce(text, F.lit("")), SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        dup_lines(text).alias("n_dup_lines"),
        repeat_words(F.col("_words")).alias("n_repeat_words"),
        class_counts(text).alias("classes"),
        word_bins(F.col("_words"), ref["common"]).alias("bins"),
    )
    marked = marked.withColumn("_counts", counts)
    c = F.col("_counts")
    distances = F.struct(
        F.when(_total(c["classes"]) >= MIN_CLASS_CHARS, js_distance(c["classes"], ref["class_reference"])).alias("class_distance"),
        F.when(c["n_words"] >= MIN_HISTOGRAM_WORDS, js_distance(c["bins"], ref["word_reference"])).alias("word_distance"),
    )
    marked = marked.withColumn("_far", distances)
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])
    far = F.coalesce(F.col("_far.class_distance") > max_class_distance, F.lit(False)) | F.coalesce(F.col("_far.word_distance") > max_word_distance, F.lit(False))
    verdict = F.struct(
        *[c[b].alias(b) for b in base], F.col("_far.class_distance"), F.col("_far.word_distance"), failed.alias("base_failed"), (~failed & ~far).alias("kept")
    )
    # Behind a generator a filter on the verdict reads it; pushed into the expressions
    # above it would repeat them beyond bounds.
    marked = marked.select("row", F.explode(F.array(verdict)).alias("verdict"))
    return marked.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() != out.lower()], F.col("verdict").alias(out))
