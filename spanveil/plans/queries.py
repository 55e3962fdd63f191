"""The registered queries: every operator on the driver's tables, or on data derived from them."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanveil.functions.pseudonyms import constant_masks
from spanveil.functions.dictionaries import ENTITY_TYPES
from spanveil.operators import metrics as M, review as V, stats as A
from spanveil.operators.detect import detect, detect_distinct, explode_fates, explode_spans
from spanveil.operators.external import (
    analyzer_candidates, attach_spans, model_spans, ner_candidates,
)
from spanveil.operators.mapping import (
    build_mapping, shared_fakes, suppress_frequent_in_corpus,
)
from spanveil.operators.protected import with_protected
from spanveil.operators.recognizers import recognize
from spanveil.operators.redact import redact, redact_runs, replace_text, runs_text
from spanveil.operators.resolve import dedupe, resolve_overlaps
from spanveil.plans import item_queries
from spanveil.plans.planted import gate_cases, notes
from spanveil.plans.redaction import keep, new_folder, redact_table
from spanveil.plans.replacement import replace_by_table
from spanveil.schema import CANDIDATES, MAPPING
from spanveil.sources.docx import paragraph_runs, read_docx, register_docx
from spanveil.sources.html import page_paragraphs, page_runs, rebuild_pages
from spanveil.sources.tables import paragraphs, spread, write_mapping
from spanveil.streaming.redaction import redact_stream, redact_with_mapping
from spanveil.streaming.store import files, stream_mapping_table

Query = Callable[[SparkSession, str], DataFrame]
MASKS = constant_masks(ENTITY_TYPES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(notes(table(spark, sf_dir, "customer")))


def _long(df: DataFrame, *keys: str) -> DataFrame:
    """Spans with plain column names and 64-bit offsets."""
    return df.select(*keys, F.col("start").cast("bigint").alias("span_start"),
                     F.col("end").cast("bigint").alias("span_end"), "text", "entity_type")


# --- recognizers -----------------------------------------------------------------------

def _recognized(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = recognize(documents(spark, sf_dir), names=[name], output="found")
        rows = explode_spans(found, ["doc_id"], "found").where("reason IS NULL")
        return _long(rows, "doc_id")
    return query


def _planted(*types: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spans = explode_spans(detect(_notes(spark, sf_dir)), ["note_id"])
        return _long(spans.where(F.col("entity_type").isin(*types)), "note_id")
    return query


def _planted_by_label(label: str) -> Query:
    """ADDRESS spans after an office label or a field label."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        spans = explode_spans(detect(_notes(spark, sf_dir)), ["note_id", "prefix"])
        return _long(spans.where(F.col("prefix") == label), "note_id")
    return query


# --- protected phrases -----------------------------------------------------------------

PHRASE_TEXT = """CASE p_partkey % 6
    WHEN 0 THEN 'Lot ' || CAST(p_partkey AS STRING) || ' at Offer Price today'
    WHEN 1 THEN 'Lot ' || CAST(p_partkey AS STRING) || ' of securities  and Exchange Board of INDIA now'
    WHEN 2 THEN 'Lot ' || CAST(p_partkey AS STRING) || ' see Board/ Board of Directors there'
    WHEN 3 THEN 'Lot ' || CAST(p_partkey AS STRING) || ' was offered by sebiX'
    WHEN 4 THEN 'Lot ' || CAST(p_partkey AS STRING) || ' National Stock Exchange of India Limited end'
    ELSE 'ipo@lot' || CAST(p_partkey AS STRING) || '.com and pio@lot' || CAST(p_partkey AS STRING) || '.com'
    END"""


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "part").selectExpr("p_partkey", f"{PHRASE_TEXT} AS text"))


def protected_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = with_protected(_phrases(spark, sf_dir))
    return spans.select("p_partkey", F.inline_outer("protected")).where("start IS NOT NULL").select(
        "p_partkey", F.col("start").cast("bigint").alias("span_start"),
        F.col("end").cast("bigint").alias("span_end"))


def protected_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = detect(_phrases(spark, sf_dir), recognizers=["email"], rejected="rejected")
    return explode_fates(judged, ["p_partkey"]).select(
        "p_partkey", "text", F.col("reason").alias("fate"))


# --- gates -----------------------------------------------------------------------------

def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(gate_cases(table(spark, sf_dir, "customer")))


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = _cases(spark, sf_dir)
    texts = cases.select("note_id", "text", "source")
    joined = attach_spans(texts, cases.select("note_id", "start", "end", "label", "score"),
                          "note_id")
    empty = F.slice("raw_spans", 1, 0)
    split = joined.withColumn("_ner", F.when(F.col("source") == "spacy", F.col("raw_spans"))
                              .otherwise(empty)).withColumn(
        "_an", F.when(F.col("source") == "presidio", F.col("raw_spans")).otherwise(empty))
    df = analyzer_candidates(ner_candidates(split, "_ner", "ner"), "_an", "analyzer")
    return detect(df, external=["ner", "analyzer"], rejected="rejected")


def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return explode_fates(_gated(spark, sf_dir), ["note_id"]).select(
        "note_id", "entity_type", F.col("start").cast("bigint").alias("span_start"),
        F.col("end").cast("bigint").alias("span_end"), F.col("source").alias("span_source"),
        F.col("reason").alias("fate"))


def gate_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.rejection_counts(_gated(spark, sf_dir), semantic_input="spans")


def confidence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower bars let more through: PERSON spans under relaxed thresholds."""
    cases = _cases(spark, sf_dir)
    texts = cases.withColumn("raw", F.array(F.struct(
        "start", "end", F.expr("substring(text, start + 1, end - start)").alias("text"), "label",
        "score")))
    df = ner_candidates(texts, "raw", "ner")
    relaxed = detect(df, external=["ner"], confidence=0.5, thresholds={"PERSON": 0.6},
                     source_thresholds={"spacy": 0.7})
    spans = explode_spans(relaxed, ["note_id", "label"])
    return _long(spans.where("source = 'spacy' AND label = 'PERSON'"), "note_id")


def frequency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name that a model finds 45 to 56 times in one text."""
    texts = spread(table(spark, sf_dir, "supplier").select("s_suppkey")).selectExpr(
        "s_suppkey", "CAST(45 + s_suppkey % 12 AS INT) AS n").withColumn(
        "text", F.expr("repeat('Rashi Patil met us; ', n)"))
    raw = F.expr("transform(sequence(0, n - 1), i -> named_struct('start', i * 20, 'end', "
                 "i * 20 + 11, 'text', 'Rashi Patil', 'label', 'PERSON', 'score', 0.99D))")
    df = analyzer_candidates(texts.withColumn("raw", raw), "raw", "analyzer")
    judged = detect(df, external=["analyzer"], rejected="rejected")
    return judged.select(
        "s_suppkey", F.size("spans").cast("bigint").alias("kept"),
        F.size(F.filter("rejected", lambda c: c["reason"] == "frequency_suppressed")).cast(
            "bigint").alias("suppressed"))


def corpus_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values by supplier; some suppliers have far more line items than the limit."""
    spans = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "concat(if(l_linenumber % 2 = 0, 'Acme ', 'ACME '), l_partkey) AS text",
        "CASE l_suppkey % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' ELSE 'EMAIL' END AS entity_type",
        "CASE WHEN l_suppkey % 4 = 0 THEN 1.0D ELSE 0.99D END AS score")
    kept = suppress_frequent_in_corpus(spans, limit=30)
    return kept.groupBy("text", "entity_type").agg(F.count("*").alias("n"))


def _find_names(texts: list[str]) -> list[list[tuple[int, int, str, float]]]:
    name = re.compile(r"\b[A-Z][a-z]+ [A-Z][a-z]+(?=\d)")
    return [[(m.start(), m.end(), "PERSON", 0.97) for m in name.finditer(t)] for t in texts]


def model_recognizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's model, loaded once per task, as analyzer."""
    cases = _cases(spark, sf_dir).select("note_id", "text")
    raw = cases.withColumn("raw", model_spans(F.col("text"), lambda: _find_names))
    df = analyzer_candidates(raw, "raw", "analyzer")
    found = explode_spans(detect(df, external=["analyzer"]), ["note_id"])
    return _long(found.where("source = 'presidio'"), "note_id")


# --- deduplication and overlaps --------------------------------------------------------

def _line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order an array of candidates computed from its line items."""
    lines = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "CAST(l_partkey % 20 AS INT) AS start", "CAST(l_partkey % 20 + 1 + l_suppkey % 9 AS INT) AS end",
        "CAST(0.9 AS DOUBLE) + CAST(l_suppkey % 3 AS DOUBLE) / 100 AS score",
        "CASE l_partkey % 3 WHEN 0 THEN 'regex' WHEN 1 THEN 'presidio' ELSE 'spacy' END AS source")
    return lines.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct(
        "l_linenumber", "l_partkey", "l_suppkey", "start", "end", "score", "source"))).alias("x")
    ).withColumn("candidates", F.transform("x", lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"),
        F.concat_ws("-", s["l_linenumber"], s["l_partkey"], s["l_suppkey"]).alias("text"),
        F.lit("ORG").alias("entity_type"), s["score"].alias("score"), s["source"].alias("source"),
        F.lit(None).cast("string").alias("reason"))).cast(CANDIDATES)).drop("x")


def _kept(df: DataFrame, column: str) -> DataFrame:
    rows = explode_spans(df, ["l_orderkey"], column).where("reason IS NULL")
    return rows.select("l_orderkey", F.col("start").cast("bigint").alias("span_start"),
                       F.col("end").cast("bigint").alias("span_end"), "score", "source")


def dedupe_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(dedupe(_line_spans(spark, sf_dir), "candidates", "unique"), "unique")


def resolved_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = dedupe(_line_spans(spark, sf_dir), "candidates", "unique").withColumn(
        "single", F.expr("filter(unique, c -> c.reason IS NULL)"))
    return _kept(resolve_overlaps(unique, "single", "settled"), "settled")


# --- counts and reports ----------------------------------------------------------------

def type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = explode_spans(detect(documents(spark, sf_dir)), ["doc_id"])
    return A.type_counts(spans).select(
        F.coalesce("entity_type", F.lit("(all)")).alias("entity_type"), "n")


def distinct_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, detecting each distinct text once per salt."""
    docs = documents(spark, sf_dir)
    spans = explode_spans(detect_distinct(docs, ["doc_id"]), ["doc_id"])
    return A.type_counts(spans).select(
        F.coalesce("entity_type", F.lit("(all)")).alias("entity_type"), "n")


def detection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = keep(explode_spans(detect(_notes(spark, sf_dir)), ["note_id"]))
    return A.detection_report(spans, A.unique_values(spans)).drop("position")


def doc_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.text_statistics(paragraphs(documents(spark, sf_dir), ["doc_id"]))


def paragraph_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = paragraphs(table(spark, sf_dir, "documents"), ["doc_id"])
    return lines.select("doc_id", F.col("para_no").cast("bigint").alias("para_no"),
                        F.length("text").cast("bigint").alias("n_chars"))


def page_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables per page; every page gets one with a cell and one without."""
    added = F.expr("html || '<table><tr><td>' || CAST(page_id AS STRING) || '</td></tr></table>"
                   "<table></table>'")
    return table(spark, sf_dir, "pages").select(
        "page_id", A.count_tables(added).cast("bigint").alias("tables"),
        F.length("html").cast("bigint").alias("characters"))


# --- mapping and redaction -------------------------------------------------------------

def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An existing mapping for a part of the values, and one value that does not occur."""
    old = _notes(spark, sf_dir).where("kind IS NOT NULL AND note_id % 5 = 0").select(
        F.col("value").alias("original"), F.col("kind").alias("entity_type"),
        F.concat(F.lit("old-"), F.upper("value")).alias("replacement"))
    unused = spark.createDataFrame([("never seen", "PERSON", "still here")], MAPPING)
    return old.distinct().unionByName(unused)


def pseudonym_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    detected = keep(detect(_notes(spark, sf_dir).select("note_id", "text")))
    return build_mapping(detected, ["note_id"], _known(spark, sf_dir))


def fake_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals that share a fake: here every fake is its type's mask."""
    detected = keep(detect(_notes(spark, sf_dir).select("note_id", "text")))
    return shared_fakes(build_mapping(detected, ["note_id"], generators=MASKS))


def redact_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redact(detect(documents(spark, sf_dir)), generators=MASKS).select("doc_id", "redacted")


def redact_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the full mapping: old entries win."""
    texts = _notes(spark, sf_dir)
    return redact_table(texts, ["note_id"], _known(spark, sf_dir)).redacted.select(
        "note_id", "redacted")


def redact_note_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each note cut into four runs, two cuts inside the value."""
    runs = _notes(spark, sf_dir).select("note_id", F.array(*[
        F.struct(F.lit(i).alias("run_no"), F.expr(sql).alias("run_text")) for i, sql in enumerate([
            "prefix", "left(value, 2)", "substring(value, 3, 3)",
            "substring(value, 6) || suffix"])]).alias("runs"))
    texts = runs.withColumn("text", runs_text(F.col("runs")))
    out = redact_runs(detect(texts), generators=MASKS)
    return out.select("note_id", F.inline("redacted_runs"), "replacements").select(
        "note_id", F.col("run_no").cast("bigint").alias("run_no"), "run_text",
        F.col("replacements").cast("bigint").alias("replacements"))


def _noted_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a card number that inline markup cuts in two, and one in an attribute."""
    return table(spark, sf_dir, "pages").selectExpr(
        "page_id", "html || '<p title=\"4111111111111111\">Paid by 4111 <b>1111 1111</b> 1111 "
        "twice</p><p>4111 1111</p><p>1111 1111</p>' AS html")


def page_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = page_runs(_noted_pages(spark, sf_dir))
    return pages.select("page_id", F.array_join("pieces", "").alias("html"))


def redact_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages, all types, as they come."""
    return _redacted_pages(spread(_noted_pages(spark, sf_dir))).select("page_id", "redacted_html")


def _redacted_pages(pages: DataFrame) -> DataFrame:
    found = keep(detect(page_paragraphs(pages, ["page_id"])).where(F.size("spans") > 0))
    return rebuild_pages(pages, redact_runs(found, generators=MASKS), ["page_id"])


def redact_page_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole pages, all types: the note of the page's number opens its article, markup inside the value."""
    notes = _notes(spark, sf_dir).selectExpr(
        "note_id AS page_id", "prefix || left(value, 2) || '<b>' || substring(value, 3) || '</b>' || suffix AS note")
    pages = _noted_pages(spark, sf_dir).join(notes, "page_id", "left").selectExpr(
        "page_id", "replace(html, '<article>', '<article><p>' || coalesce(note, '') || '</p>') AS html")
    return _redacted_pages(spread(pages)).select("page_id", "redacted_html")


WORDS = {"ing": "_", "tion": "<t>", "ingtion": "<it>", "e": "3"}


def literal_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", replace_text(F.col("text"), WORDS).alias("text"))


def table_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries from the texts: the first word of each, to lose its first letter and gain another; so
    replacements make words that further entries replace."""
    texts = documents(spark, sf_dir)
    words = texts.select(F.element_at(F.split("text", " "), 1).alias("original")).where("length(original) >= 3").distinct()
    entries = words.withColumn("replacement", F.expr("substring(original, 2) || 'e'"))
    return replace_by_table(texts, entries, ["doc_id"]).select("doc_id", F.col("replaced").alias("text"))


# --- scoring ---------------------------------------------------------------------------

def _truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planted spans, some left out, shifted or with another type; and some false ones."""
    planted = _notes(spark, sf_dir).where("kind IS NOT NULL AND note_id % 10 <> 1")
    shifted = F.when(F.col("note_id") % 7 == 2, 1).otherwise(0)
    kind = F.when(F.col("note_id") % 11 == 3, F.lit("PERSON")).otherwise(F.col("kind"))
    return planted.select("note_id", (F.length("prefix") + shifted).cast("int").alias("start"),
                          F.length(F.concat("prefix", "value")).cast("int").alias("end"),
                          kind.alias("entity_type"))


def _predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(detect(_notes(spark, sf_dir).select("note_id", "text")))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    predicted = explode_spans(_predicted(spark, sf_dir), ["note_id"])
    return M.compare_spans(_truth(spark, sf_dir), predicted, ["note_id"])


def exact_match_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = ["precision", "recall", "f1"]
    return M.exact_metrics(_compared(spark, sf_dir)).select(
        "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in scores])


def span_type_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.type_totals(_compared(spark, sf_dir))


def char_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    detected = _predicted(spark, sf_dir)
    counts = M.character_counts(detected, _truth(spark, sf_dir),
                                explode_spans(detected, ["note_id"]), ["note_id"])
    return M.character_accuracy(counts).select("characters", "agree", F.round(
        "accuracy", 6).alias("accuracy"))


def span_metrics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    detected = _predicted(spark, sf_dir)
    truth, predicted = _truth(spark, sf_dir), explode_spans(detected, ["note_id"])
    accuracy = M.character_accuracy(M.character_counts(detected, truth, predicted, ["note_id"]))
    report = M.span_report(M.compare_spans(truth, predicted, ["note_id"]), accuracy).drop("position")
    return report.withColumn("value", F.when(
        F.col("metric").isin("Precision", "Recall", "F1 Score", "Accuracy"),
        F.format_number(F.col("value").try_cast("double"), 6)).otherwise(F.col("value")))


def binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does a card number or mail address predict the label ``toxic``?"""
    labels = table(spark, sf_dir, "labels")
    docs = detect(documents(spark, sf_dir).join(labels.select("doc_id"), "doc_id", "left_semi"),
                  recognizers=["email", "card"]).select(
        "doc_id", (F.size("spans") > 0).cast("int").alias("predicted"))
    pairs = docs.join(labels, "doc_id")
    scores = ["accuracy", "precision", "recall", "f1"]
    return M.binary_metrics(M.binary_counts(pairs, "toxic", "predicted")).select(
        "total", "fp", "fn", *[F.round(c, 6).alias(c) for c in scores])


# --- review ----------------------------------------------------------------------------

def review_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = documents(spark, sf_dir)
    detected, mapping, redacted = redact_table(texts, ["doc_id"], generators=MASKS)
    sheet = V.review_sheet(mapping, detected, redacted.select(
        "doc_id", F.col("redacted").alias("text")), ["doc_id"])
    return sheet


def word_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short and long, overlapping and capitalised values, part of words too."""
    words = table(spark, sf_dir, "customer").selectExpr(
        "CASE c_custkey % 6 WHEN 0 THEN 'Th' WHEN 1 THEN 'ingin' WHEN 2 THEN 'E' "
        "WHEN 3 THEN 'the entionly' WHEN 4 THEN 'ANDTHE' ELSE 'Not There ' || "
        "CAST(c_custkey AS STRING) END AS value").distinct()
    return V.occurrences(documents(spark, sf_dir), words, ["doc_id"])


def review_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts from the planted kinds: addresses count as wrong."""
    notes_ = _notes(spark, sf_dir).where("kind IS NOT NULL")
    sheet = notes_.groupBy(F.col("value").alias("original"), "kind").agg(
        F.count("*").alias("n")).select(
        "original", F.when(F.col("n") > 1, F.col("n")).alias("original_occurrences"),
        F.when(F.col("kind") == "ADDRESS", F.lit("no")).otherwise(F.lit(" YES ")).alias(
            "is_actual_pii"))
    scores = ["precision", "recall", "f1", "accuracy"]
    return V.review_metrics(sheet, missed=12, true_negatives=30).select(
        "reviewed", "tp", "fp", "tp_occurrences", "fp_occurrences",
        *[F.round(c, 6).alias(c) for c in scores])


# --- streams and files -----------------------------------------------------------------

def _scratch(spark: SparkSession) -> str:
    return new_folder(spark, "stream")


def _chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/conversations.parquet"
    turns = spark.readStream.schema(spark.read.parquet(path).schema)
    system, place = files(spark, path)
    if system.getFileStatus(place).isDirectory():
        turns = turns.parquet(path)
    else:  # a stream reads folders: the one of a single file, for that file
        turns = turns.option("pathGlobFilter", "conversations.parquet").parquet(sf_dir)
    return turns.select("conv_id", "turn", F.expr(
        "text || ' Mail to user' || CAST(conv_id AS STRING) || '@mail.example.com now.'").alias("text"))


def stream_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _scratch(spark)
    out = redact_stream(_chats(spark, sf_dir), generators=MASKS)
    query = out.select("conv_id", "turn", "redacted").writeStream.format("parquet").option(
        "path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(
        availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema("conv_id bigint, turn bigint, redacted string").parquet(f"{folder}/out")


def _mapped_chats(spark: SparkSession, sf_dir: str) -> str:
    """Two jobs, each with a checkpoint of its own, over a mapping that was saved before."""
    folder = _scratch(spark)
    saved = table(spark, sf_dir, "conversations").where("conv_id % 3 = 0").select(
        F.expr("'user' || CAST(conv_id AS STRING) || '@mail.example.com'").alias("original"),
        F.lit("EMAIL").alias("entity_type"),
        F.expr("'saved-' || CAST(conv_id AS STRING)").alias("replacement")).distinct()
    write_mapping(saved, f"{folder}/mapping")
    for job, masks in (("first", MASKS), ("second", None)):  # the second makes no entry anew
        redact_with_mapping(_chats(spark, sf_dir), ["conv_id", "turn"], f"{folder}/mapping",
                            f"{folder}/{job}", f"{folder}/state-{job}", generators=masks).awaitTermination()
    return folder


def stream_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_mapping_table(spark, f"{_mapped_chats(spark, sf_dir)}/mapping")


def stream_mapped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema("conv_id bigint, turn bigint, redacted string").parquet(
        f"{_mapped_chats(spark, sf_dir)}/second").select("conv_id", "turn", "redacted")


def _as_docx(texts: pd.Series) -> pd.Series:
    def pack(text: str) -> bytes:
        paras = "".join(
            f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>'
            for line in text.split("\n"))
        name = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr("word/document.xml", f'<w:document xmlns:w="{name}"><w:body>'
                             f"{paras}</w:body></w:document>")
        return out.getvalue()
    return texts.map(pack)


def docx_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents packed as Word files and read back as runs."""
    clean = F.regexp_replace("text", r"[\x00-\x08\x0b-\x1f\ufffe\uffff]", " ")
    files = documents(spark, sf_dir).select("doc_id", F.pandas_udf(_as_docx, "binary")(clean).alias("content"))
    register_docx(spark)
    return spark.sql(
        "SELECT doc_id, CAST(r.para_no AS BIGINT) AS para_no, r.run_text "
        "FROM {files}, LATERAL docx_runs(content) r", files=files)


W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"


def _note_docx(runs: list[list[str]]) -> bytes:
    """A document with the runs of one paragraph in its body, one in a table cell, one in the header."""
    body, cell, head = ("<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>' for t in some) + "</w:p>"
                        for some in runs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("word/document.xml", (
            f'<w:document xmlns:w="{W}" xmlns:r="{R}"><w:body>{body}<w:tbl><w:tr><w:tc>{cell}</w:tc></w:tr></w:tbl>'
            '<w:sectPr><w:headerReference w:type="default" r:id="h"/></w:sectPr></w:body></w:document>'))
        archive.writestr("word/_rels/document.xml.rels", (
            f'<Relationships xmlns="{RELS}"><Relationship Id="h" Target="header1.xml"/></Relationships>'))
        archive.writestr("word/header1.xml", f'<w:hdr xmlns:w="{W}">{head}</w:hdr>')
    return out.getvalue()


def _write_docx(folder: str):
    """Write each note's document under its number, in a folder of some: a task that runs again writes the same files."""
    def run(batches):
        system, root = fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)
        system.create_dir(root, recursive=True)
        made = set()
        for batch in batches:
            for r in batch.to_pylist():
                if r["file"] not in made:
                    system.create_dir(f"{root}/{r['file']}")
                    made.add(r["file"])
                with system.open_output_stream(f"{root}/{r['file']}/{r['note_id']}.docx") as out:
                    out.write(_note_docx(r["runs"]))
            yield pa.RecordBatch.from_arrays([batch.column("note_id")], ["note_id"])
    return run


def docx_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word files of notes, read from a folder and redacted run by run: body, table cell and header."""
    folder = _scratch(spark)
    whole = _notes(spark, sf_dir).selectExpr("note_id", (
        "array(array(prefix, left(value, 2), substring(value, 3, 3), substring(value, 6) || suffix), "
        "array(prefix || value, suffix), array(prefix || value || suffix)) AS runs"))
    # folders grow in number, not in size: the driver lists them one by one
    written = item_queries.numbered_files(whole, "note_id").mapInArrow(_write_docx(folder), "note_id bigint")
    written.agg(F.count("*")).collect()
    runs = read_docx(spark, folder)
    paras = paragraph_runs(runs.withColumn("note_id", F.regexp_extract("path", r"(\d+)\.docx$", 1).cast("bigint")), ["note_id"])
    # headers and cells repeat what bodies say: each text is searched once
    found = detect_distinct(keep(paras), ["note_id", "story", "para_no"])
    out = redact_runs(found, generators=MASKS)
    return out.select("note_id", "story", F.col("para_no").cast("bigint").alias("para_no"), F.inline("redacted_runs")).select(
        "note_id", "story", "para_no", F.col("run_no").cast("bigint").alias("run_no"), "run_text")


def queries() -> dict[str, Query]:
    return {
        "email_spans": _recognized("email"), "ip_spans": _recognized("ip"),
        "card_spans": _recognized("card"),
        "planted_phone": _planted("PHONE"), "planted_ssn": _planted("SSN"),
        "planted_dob": _planted("DOB"), "planted_org": _planted("ORG"),
        "planted_address_office": _planted_by_label("Registered Office: "),
        "planted_address_field": _planted_by_label("Taluka: "),
        "planted_spans": _planted(*ENTITY_TYPES),
        "protected_spans": protected_spans, "protected_drop": protected_drop,
        "gate_reasons": gate_reasons, "gate_tally": gate_tally,
        "confidence_gate": confidence_gate, "frequency_gate": frequency_gate,
        "corpus_frequency": corpus_frequency, "model_recognizer": model_recognizer,
        "dedupe_spans": dedupe_spans, "resolve_overlaps": resolved_spans,
        "type_counts": type_counts, "distinct_type_counts": distinct_type_counts,
        "detection_report": detection_report, "doc_stats": doc_stats,
        "paragraph_lengths": paragraph_lengths, "page_stats": page_stats,
        "pseudonym_map": pseudonym_map, "fake_collisions": fake_collisions,
        "redact_documents": redact_documents, "redact_notes": redact_notes,
        "redact_runs": redact_note_runs, "page_round_trip": page_round_trip,
        "redact_pages": redact_pages, "redact_page_bodies": redact_page_bodies, "literal_replace": literal_replace,
        "table_replace": table_replace,
        "exact_match_metrics": exact_match_metrics, "span_type_totals": span_type_totals,
        "char_accuracy": char_accuracy, "span_metrics_report": span_metrics_report,
        "binary_metrics": binary_metrics, "review_sheet": review_sheet,
        "word_occurrences": word_occurrences, "review_metrics": review_metrics,
        "stream_redaction": stream_redaction, "stream_mapping": stream_mapping,
        "stream_mapped_texts": stream_mapped_texts,
        "docx_runs": docx_runs, "docx_redaction": docx_redaction,
        **item_queries.queries(),
    }
