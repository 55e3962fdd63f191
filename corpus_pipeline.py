"""The corpus pipeline: what to keep of a documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and gives a frame; all but the last keep the columns of
documents. A runner writes each result and reads it back as the next stage's input.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanveil.llm.common import crc_fold, free_name, hold, join_checked, outlive, release, scratch, table
from spanveil.llm.decontaminate import decontaminate
from spanveil.llm.jaccard_join import similar_components, with_class
from spanveil.llm.languages import UNDETERMINED, learn, predict
from spanveil.llm.secrets import infer, labelled, mask_secrets
from spanveil.llm.tokenize import encode

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: Near duplicates: word shingles and percent of similarity.
SHINGLE, PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, or not a letter in them) go; ``lang`` is as predicted.

    Languages are learned from the labelled rows of this stage's input, one fold of three apart.
    """
    prototypes = learn(docs.where(crc_fold(F.col("doc_id"), 3) != 1))
    lang, score = free_name(docs, "_lang"), free_name(docs, "_score")
    named = predict(docs, prototypes, lang_as=lang, score_as=score).where(F.col(lang) != UNDETERMINED)
    return named.select(*[F.col(lang).alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays.

    Each row is judged by its own text: it goes if a row of its group has a smaller id. Of rows of
    a group that share the smallest id (and may differ in text), one stays. Empty texts are
    linked with nothing; rows with a null id make no link and stay.
    """
    cls = free_name(docs, "_class")
    with scratch(spark):
        rows = similar_components(docs, shingle=SHINGLE, percent=PERCENT).where(
            "doc_id IS NOT NULL AND class_id IS NOT NULL").select("doc_id", F.col("class_id").alias(cls), "group_id")
        row = F.struct("doc_id", cls)
        firsts = rows.groupBy("group_id").agg(F.min(row).alias("first"), F.count("*").alias("n")).where("n > 1")
        grouped = rows.join(firsts, "group_id")
        gone = outlive(hold(grouped.where(row != F.col("first")).select("doc_id", cls).distinct(), "gone"))
        again = outlive(hold(grouped.where(row == F.col("first")).groupBy("doc_id", cls).count().where("count > 1").select(
            "doc_id", cls), "again"))
    kept = join_checked(with_class(docs, cls, shingle=SHINGLE), gone, ["doc_id", cls], "left_anti")
    if again.isEmpty():
        return kept.select(docs.columns)
    once = kept.join(again, ["doc_id", cls], "left_semi").dropDuplicates(["doc_id", cls])
    return kept.join(again, ["doc_id", cls], "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold passages of the benchmark go."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the text; every document stays, ``n_chars`` follows."""
    masked = mask_secrets(docs, infer(labelled(docs)))
    return masked.select(*[F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
                           if c == "n_chars" else F.col(c) for c in docs.columns])


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, with the digests that show the round trip."""
    return encode(docs, VOCABULARY, public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontamination),
    ("secret_scans", secrets), ("byte_bpe", tokens)]

ORACLE_SQL = None  # profiles, inferred automata and merges are no SQL; tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            after = outlive(hold(stage(spark, docs, sf_dir), name))
        release(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
