"""Registered queries for single items: files written and read back, and rules that other queries do not reach."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from spanveil.functions.arrays import literal
from spanveil.functions.dictionaries import ENTITY_TYPES
from spanveil.functions.pseudonyms import constant_masks
from spanveil.operators import metrics as M, review as V, stats as A
from spanveil.operators.detect import detect, explode_fates, explode_spans
from spanveil.operators.external import analyzer_candidates, attach_spans, ner_candidates
from spanveil.operators.gates import apply_confidence
from spanveil.operators.mapping import extend_mapping, first_types
from spanveil.operators.redact import redact
from spanveil.plans.planted import dictionary_entries, gate_cases, notes
from spanveil.plans.redaction import keep, new_folder
from spanveil.sources import tables as T

Query = Callable[[SparkSession, str], DataFrame]
FILE_ENTRIES = 5_000  # entries of a written JSON object, or of a folder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.spread(notes(_table(spark, sf_dir, "customer")))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _notes(spark, sf_dir).where("kind IS NOT NULL").select("value", "kind").distinct()


def _mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _values(spark, sf_dir).selectExpr("value AS original", "kind AS entity_type", "'x-' || value AS replacement")


# --- files -----------------------------------------------------------------------------

def saved_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "mapping")
    T.write_mapping(_mapping(spark, sf_dir), folder, "json")
    return T.read_mapping(spark, folder, "json")


def numbered_files(rows: DataFrame, key: str) -> DataFrame:
    """Rows with the number of the file (or folder) that they go to; files grow in number, not in size."""
    files = 1 + rows.count() // FILE_ENTRIES
    return rows.withColumn("file", F.pmod(F.xxhash64(key), F.lit(files)))


def legacy_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of JSON objects, original to replacement."""
    folder = new_folder(spark, "legacy")
    numbered_files(_mapping(spark, sf_dir), "original").groupBy("file").agg(F.to_json(F.map_from_entries(
        F.collect_list(F.struct("original", "replacement")))).alias("value")).select("value", "file").repartition(
        "file").write.partitionBy("file").text(folder)
    return T.read_legacy_mapping(spark, folder).select("original", "replacement")


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated documents, many to a file, read and checked."""
    folder = new_folder(spark, "truth")
    entity = F.struct(F.col("s").cast("int").alias("start"), F.col("e").cast("int").alias("end"), F.col("kind").alias("entity_type"))
    docs = _notes(spark, sf_dir).selectExpr("*", "length(prefix) AS s", "length(prefix) + length(value) AS e").select(
        F.struct(F.col("note_id").cast("string").alias("id"), "text", F.when(F.col("kind").isNull(), F.array().cast(
            "array<struct<start:int,end:int,entity_type:string>>")).otherwise(F.array(entity)).alias("entities")).alias("d"), "note_id")
    numbered_files(docs, "note_id").groupBy("file").agg(F.to_json(F.struct(F.collect_list("d").alias("documents"))).alias(
        "value")).repartition("file").write.partitionBy("file").text(folder)
    return T.read_ground_truth(spark, f"{folder}/file=*").select(
        "id", "text", F.size("entities").cast("bigint").alias("entities"),
        F.get("entities", F.lit(0))["start"].cast("bigint").alias("first_start"),
        F.get("entities", F.lit(0))["entity_type"].alias("first_type"))


def saved_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet with commas, quotes and line ends in its cells."""
    folder = new_folder(spark, "review")
    T.write_review(_values(spark, sf_dir).selectExpr(
        "value AS original", "'x, \"' || value || '\"' AS replacement", "CAST(length(value) AS BIGINT) AS original_occurrences",
        "1L AS replacement_occurrences", "'a\\n' || value AS source_context", "if(kind = 'ORG', 'no', 'yes') AS is_actual_pii",
        "'' AS entity_type", "'' AS notes"), folder)
    return T.read_review(spark, folder).select("original", "replacement", "original_occurrences", "source_context", "is_actual_pii")


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = keep(explode_spans(detect(_notes(spark, sf_dir)), ["note_id"]))
    return A.detection_report(spans, A.unique_values(spans))


def saved_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "metrics")
    T.write_metrics(_report(spark, sf_dir), folder)
    return T.read_metrics(spark, folder).select(F.col("position").cast("bigint").alias("position"), "metric", "value")


def saved_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics, read back from their file, as a text report: its lines by number."""
    metrics, folder = new_folder(spark, "metrics"), new_folder(spark, "report")
    T.write_metrics(_report(spark, sf_dir), metrics)
    T.write_report(T.read_metrics(spark, metrics), folder)
    lines = spark.read.text(folder, wholetext=True).select(F.posexplode(F.split(F.rtrim("value", F.lit("\n")), "\n")).alias("n", "line"))
    return lines.select(F.col("n").cast("bigint").alias("line_no"), "line")


def saved_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "redacted")
    done = redact(detect(_notes(spark, sf_dir)), generators=constant_masks(ENTITY_TYPES))
    T.write_redacted(done.select("note_id", "redacted", F.coalesce("kind", F.lit("none")).alias("part")), folder, ["part"])
    return spark.read.schema("note_id bigint, redacted string, part string").parquet(folder)


# --- rules -----------------------------------------------------------------------------

def recheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External spans that come to the confidence gate as they are: dictionaries are asked there too."""
    cases = T.spread(gate_cases(_table(spark, sf_dir, "customer")))
    joined = attach_spans(cases.select("note_id", "text", "source"), cases.select("note_id", "start", "end", "label", "score"), "note_id")
    some = lambda source: F.when(F.col("source") == source, F.col("raw_spans")).otherwise(F.slice("raw_spans", 1, 0))
    split = joined.withColumn("_ner", some("spacy")).withColumn("_an", some("presidio"))
    df = analyzer_candidates(ner_candidates(split, "_ner", "ner"), "_an", "analyzer").withColumn("all", F.concat("ner", "analyzer"))
    out = apply_confidence(df, "all", "judged", recheck=True)
    return out.select("note_id", F.inline("judged")).select("note_id", F.coalesce("reason", F.lit("kept")).alias("fate"))


def blank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that reports a name in every text, blank ones too."""
    texts = T.spread(_table(spark, sf_dir, "customer").select("c_custkey")).selectExpr("c_custkey AS note_id", (
        "CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '  \\n ' WHEN 2 THEN '\\t\\u00a0' ELSE 'Rashi Patil at a@b.com' END AS text"))
    raw = F.expr("array(named_struct('start', 0, 'end', 11, 'text', 'Rashi Patil', 'label', 'PERSON', 'score', 0.99D))")
    found = detect(analyzer_candidates(texts.withColumn("raw", raw), "raw", "analyzer"), external=["analyzer"])
    return found.select("note_id", F.size("spans").cast("bigint").alias("spans"))


def binary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    docs = T.spread(_table(spark, sf_dir, "documents").select("doc_id", "text")).join(labels.select("doc_id"), "doc_id", "left_semi")
    found = detect(docs, recognizers=["email", "card"]).select("doc_id", (F.size("spans") > 0).cast("int").alias("predicted"))
    report = M.binary_report(M.binary_metrics(M.binary_counts(found.join(labels, "doc_id"), "toxic", "predicted")))
    number = F.format_string("%.6f", F.col("value").try_cast("double"))
    return report.select("metric", F.when(F.col("value").contains("."), number).otherwise(F.col("value")).alias("value"))


def first_types_(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that come under several types: the first one counts."""
    spans = _table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber AS start", "concat('Value ', l_partkey % 500) AS text",
        "CASE l_suppkey % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' ELSE 'EMAIL' END AS entity_type")
    return first_types(spans, ["l_orderkey"])


def sheet_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of the originals in the ordered sheet."""
    ordered = V.ordered_sheet(_values(spark, sf_dir).select(F.col("value").alias("original")).distinct())
    return spark.createDataFrame(ordered.rdd.zipWithIndex().map(lambda r: (r[1], r[0][0])), "position bigint, original string")


def document_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of body and tables, of several runs; nested tables and headers stay out."""
    runs = _notes(spark, sf_dir).select("note_id", F.explode(F.array(*[
        F.struct(F.lit(story).alias("story"), F.lit(para).alias("para_no"), F.lit(run).alias("run_no"), F.col(text).alias("run_text"))
        for story, para, run, text in [("body", 0, 0, "prefix"), ("body", 0, 1, "value"), ("body", 1, 0, "suffix"),
                                       ("table", 2, 0, "value"), ("nested table", 3, 0, "prefix"), ("header", 4, 0, "text")]
    ])).alias("r")).select("note_id", "r.*")
    return V.document_text(runs, ["note_id"], ["body", "table"])


def seeded_fakes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extend_mapping(_values(spark, sf_dir).select(F.col("value").alias("original"), F.col("kind").alias("entity_type")), seed=7)


def dictionary_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every entry of every dictionary as an external span, in small and in capital letters."""
    entries = dictionary_entries()
    chosen = f"element_at(array({', '.join(literal(e) for e, _ in entries)}), CAST(c_custkey % {len(entries)} AS INT) + 1)"
    texts = T.spread(_table(spark, sf_dir, "customer").select("c_custkey")).selectExpr(
        "c_custkey AS note_id", f"if(c_custkey % 2 = 0, {chosen}, upper({chosen})) AS entry").selectExpr(
        "note_id", "concat('Tag x', entry, note_id) AS text",
        "array(named_struct('start', 5, 'end', 5 + length(entry), 'text', entry, 'label', 'EMAIL_ADDRESS', 'score', 0.99D)) AS raw")
    judged = detect(analyzer_candidates(texts, "raw", "analyzer"), external=["analyzer"], recognizers=["ip"], rejected="rejected")
    return explode_fates(judged, ["note_id"]).where("source = 'presidio'").select("note_id", F.col("reason").alias("fate"))


def queries() -> dict[str, Query]:
    return {
        "saved_mapping": saved_mapping, "legacy_mapping": legacy_mapping, "ground_truth": ground_truth,
        "saved_review": saved_review, "saved_metrics": saved_metrics, "saved_report": saved_report,
        "saved_redacted": saved_redacted, "recheck": recheck, "blank_texts": blank_texts,
        "binary_report": binary_report, "first_types": first_types_, "sheet_order": sheet_order,
        "document_texts": document_texts, "seeded_fakes": seeded_fakes, "dictionary_gates": dictionary_gates,
    }
