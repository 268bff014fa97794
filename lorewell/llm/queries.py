"""The queries of this subpackage over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lorewell.llm import chat, decontaminate, extract, language_model, neighbours, oracles, packing, personal, quality, simhash, tokens


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that has near-duplicates, its class and the number of its links."""
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in packs of 2,048 words."""
    return packing.pack(_read(spark, sf_dir, "documents"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability and perplexity of every document under a trigram model of all documents, with every n-gram kept."""
    scored = language_model.score(_read(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_prob", 4).alias("log_prob"), F.round("perplexity", 3).alias("perplexity"))


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids and metadata of every document, written with controlled layout and read back."""
    return tokens.token_output(_read(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, and their probability of being good."""
    kept = quality.keep_good(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), probability_as="probability")
    return kept.select("doc_id", "probability")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest neighbours found among all vectors, for every vector whose id is divisible by 50."""
    return neighbours.neighbours(_read(spark, sf_dir, "embeddings"), queries=F.col("vec_id") % 50 == 0)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, the item, and how much of it."""
    return decontaminate.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of personal data in every document."""
    return personal.personal_data(_read(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract.main_text(_read(spark, sf_dir, "pages"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as one text, and the byte ranges of what the assistant says."""
    made = chat.format_conversations(_read(spark, sf_dir, "conversations"))
    spans = F.transform(F.arrays_zip("loss_start", "loss_stop"), lambda s: F.concat_ws("-", s["loss_start"], s["loss_stop"]))
    return made.select("conv_id", "text", "n_turns", "n_bytes", F.array_join(spans, " ").alias("loss_spans"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_near_dedup,
        op2_packing,
        op3_language_model,
        op4_token_output,
        op5_quality_classifier,
        op6_nearest_neighbours,
        op7_benchmark_decontamination,
        op8_pii,
        op9_html_extraction,
        op10_chat_formatting,
    )
}
ORACLES: dict[str, str] = {"op3_language_model": oracles.LANGUAGE_MODEL, "op10_chat_formatting": oracles.CHAT}
