"""The registered queries of this folder."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanveil.llm.common import crc_fold, table
from spanveil.llm.decontaminate import benchmark_matches, contaminated
from spanveil.llm.exact_dedup import exact_duplicates
from spanveil.llm.jaccard_join import similar_components
from spanveil.llm.languages import learn, predict
from spanveil.llm.mixing import language_scores
from spanveil.llm.prefix_trie import prefix_trie
from spanveil.llm.quality import apply_policy, ledger
from spanveil.llm.secrets import find_secrets, infer, labelled
from spanveil.llm.substrings import remove_repeats
from spanveil.llm.tokenize import encode
from spanveil.llm.urls import judge
from spanveil.llm.warc import round_trip
from spanveil.llm.whitening import whiten

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents"), shingle=4, percent=85).select(
        "doc_id", "n_shingles", "component_id")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, with_ids=False)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_fold(F.col("doc_id"), 7) == 2
    scored = language_scores(table(spark, sf_dir, "documents"), ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score",
                         "score", "bits_per_byte")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    prototypes = learn(docs.where(crc_fold(F.col("doc_id"), 3) != 1))
    return predict(docs.select("doc_id", "text"), prototypes).select(
        "doc_id", (crc_fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, infer(labelled(docs)), scores="likelihoods")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    told = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(told(F.filter("secrets", lambda s: s["kind"] != "model")), 256).alias("base_sha256"),
                        told(F.col("secrets")).alias("spans"), "likelihoods")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = round_trip(table(spark, sf_dir, "pages"), least_bytes=0).where("record_type <> 'gap'")
    return records.select(
        F.col("record_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = apply_policy(apply_policy(ledger(table(spark, sf_dir, "documents").select("doc_id", "text")), "base", "base_kept"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                         (~F.col("base_kept")).alias("base_failed"), "kept")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), spans=False)
    return contaminated(found).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("bigint"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_ngram_jaccard, op2_byte_bpe, op3_lm_scoring, op4_substrings, op5_languages, op6_secrets,
                                   op7_warc, op8_quality_rules, op9_decontaminate, op10_url_filter,
                                   op11_prefix_trie, op12_exact_dedup, op13_whitening)}
