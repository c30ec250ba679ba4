"""The numbered queries over the given tables, with SQL twins where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bandloom.llm import chat, embeddings, infill, licenses, mixing, packing, postings, quality, rules, runs, simhash, sql, substrings, warc
from bandloom.llm.words import bind, word_array
from bandloom.session import cut_lineage, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit_quality(docs, labels.filter(~quality.held_out()), metadata_cols=("n_chars",))
    scored = quality.score_quality(docs, model, metadata_cols=("n_chars",))
    return scored.select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


@query("op2_simhash_dedup")
def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


@query("op3_embedding_dedup", sql.OP3)
def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op4_substring_dedup", sql.OP4)
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)
    return cut.select("doc_id", "cut.n_words", "cut.n_removed", "cut.kept_sha256")


@query("op5_warc_captures", sql.OP5)
def op5_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "archive")
    warc.write_archive(table(spark, sf_dir, "pages"), path, compression="gzip")
    # Without payloads the records are narrow, and they are read more than once.
    records = cut_lineage(warc.read_archive(spark, path, with_payload=False), "records")
    return warc.page_captures(cut_lineage(warc.assemble_captures(records), "captures"))


_OP6 = sql.op6(rules.MAX_CLASS_DISTANCE, rules.MAX_WORD_DISTANCE, rules.MIN_CLASS_CHARS, rules.MIN_HISTOGRAM_WORDS, rules.COMMON_WORDS)


@query("op6_quality_rules", _OP6)
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judge_documents(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select("doc_id", *[F.col(f"verdict.{c}") for c in base])


@query("op7_curriculum_mix", sql.OP7)
def op7_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    first = F.round(F.get("times", F.lit(0)), 6).alias("first_time")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first)


@query("op8_bin_completion_pack")
def op8_bin_completion_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.document_licences(docs, licenses.fit_licences(docs))


@query("op10_preference_format", sql.OP10)
def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    made = chat.format_preferences(turns, chat.neighbour_pairs(turns))
    masks = {c: chat.mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")}
    return made.withColumns(masks)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """Of the documents whose id asks for it, the words from one place on repeat with a period."""
    h = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    g = (h / 10).cast("bigint")

    def periodic(words):
        n = F.size(words).cast("bigint")
        a = g % n
        p = F.lit(1).cast("bigint") + F.floor((n - a) / (3 + g % 8))
        place = lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int")
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1), lambda i: F.get(words, place(i))), " ")

    planted = bind(word_array(F.col("text")), lambda words: F.when(F.size(words) > 0, periodic(words)))
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs", sql.OP11)
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = runs.mark_runs(with_planted_periods(table(spark, sf_dir, "documents")))
    best = runs.greatest_run(F.col("runs"))
    found = marked.select("doc_id", "runs", best.alias("best"))
    return found.select(
        "doc_id",
        F.size("runs.starts").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(runs.run_lines(F.col("runs")), 256).alias("runs_sha256"),
        F.sha2(F.col("runs.collapsed"), 256).alias("collapsed_sha256"),
    )


@query("op12_fill_in_middle", sql.OP12)
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    restored = infill.restore_text(F.col("infill.output"), F.col("infill.form"))
    return made.select(
        "doc_id", "infill.n", "infill.form", "infill.prefix_chars", "infill.middle_chars",
        F.sha2(F.col("infill.output"), 256).alias("output_sha256"), F.sha2(restored, 256).alias("restored_sha256"),
    )


@query("op13_benchmark_decontamination", sql.OP13)
def op13_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = postings.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return marked.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
