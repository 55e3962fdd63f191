"""Counts over spans, rejections and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanveil.functions.arrays import is_in, literal, string_array
from spanveil.functions.text import count_tokens
from spanveil.operators.gates import has_company_suffix

# Wording of the report when there is no ground truth.
NO_TRUTH = "N/A (ground truth not supplied)"
NO_TRUTH_METRICS = ("False positives", "False negatives", "Precision", "Recall", "F1 Score",
                    "Accuracy")


def type_counts(spans: DataFrame) -> DataFrame:
    """Spans per entity type, and the total in the row with entity_type NULL."""
    return spans.rollup("entity_type").agg(F.count("*").alias("n"))


# The counters that a reason adds to; other reasons count under their own name.
COUNTERS = {"public_organization": ("public_organizations_skipped", "whitelist_hits"),
            "protected_term": ("whitelist_hits", "whitelist")}


def rejection_counts(detected: DataFrame, rejected: str = "rejected", *,
                     semantic_input: str | None = None,
                     distinct_by: str | None = None) -> DataFrame:
    """Rejections per counter (reason, n).

    distinct_by: text column; each distinct text counts once.
    semantic_input: span column; adds ``private_organizations_anonymized``, the
    organisations with a legal suffix that passed the rules for their type (also
    those that lost to a duplicate or an overlap later).
    """
    columns = [c for c in (distinct_by, rejected, semantic_input) if c]
    rows = detected.select(*columns)
    if distinct_by:
        rows = rows.dropDuplicates([distinct_by])
    cases = " ".join(f"WHEN '{reason}' THEN {string_array(names)}"
                     for reason, names in COUNTERS.items())
    parts = [f"flatten(transform({rejected}, r -> CASE r.reason {cases} "
             f"ELSE array(r.reason) END))"]
    if semantic_input:
        late = is_in("r.reason", ("frequency_suppressed", "duplicate", "overlap"))
        company = f"r.entity_type = 'ORG' AND {has_company_suffix('r.text')}"
        name = literal("private_organizations_anonymized")
        parts += [f"transform(filter({semantic_input}, r -> {company}), r -> {name})",
                  f"transform(filter({rejected}, r -> {late} AND {company}), r -> {name})"]
    reasons = rows.select(F.explode(F.expr(f"concat({', '.join(parts)})")).alias("reason"))
    return reasons.groupBy("reason").agg(F.count("*").alias("n"))


def unique_values(spans: DataFrame) -> DataFrame:
    """Number of distinct values (= unique replacements)."""
    return spans.select("text").distinct().agg(F.count("*").alias("n"))


def text_statistics(paragraphs: DataFrame, text_col: str = "text") -> DataFrame:
    """Paragraphs, words (white-space separated) and characters."""
    return paragraphs.agg(
        F.count("*").alias("paragraphs"),
        F.coalesce(F.sum(F.expr(count_tokens(text_col))), F.lit(0)).cast("bigint").alias("words"),
        F.coalesce(F.sum(F.length(text_col)), F.lit(0)).cast("bigint").alias("characters"))


def count_tables(html: Column) -> Column:
    """Tables in an HTML page that have at least one cell, nested ones included."""
    cells = r"(?is)<table\b(?:(?!</table\b|<table\b).)*<(?:td|th)\b"
    return F.regexp_count(html, F.lit(cells))


def metric_row(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("metric"), value.cast("string").alias("value"))


def metrics_frame(df: DataFrame, rows: Column) -> DataFrame:
    """One row per metric: position, metric, value. The position keeps a report in order."""
    return df.select(F.posexplode(rows).alias("position", "row")).select("position", "row.metric", "row.value")


def detection_report(spans: DataFrame, replacements: DataFrame) -> DataFrame:
    """Metrics frame of a run without ground truth; types in alphabetical order.

    ``replacements``: one-row frame with column n. Only one row per type is ever
    gathered.
    """
    per_type = spans.groupBy("entity_type").agg(F.count("*").alias("n"))
    rows = per_type.withColumn("unique", F.lit(0).cast("bigint")).unionByName(replacements.select(
        F.lit(None).cast("string").alias("entity_type"), F.lit(0).cast("bigint").alias("n"),
        F.col("n").alias("unique")))
    gathered = rows.agg(
        F.sum("n").alias("total"), F.sum("unique").alias("unique"),
        F.sort_array(F.collect_list(F.when(
            F.col("entity_type").isNotNull(), F.struct("entity_type", "n")))).alias("types"))
    lines = F.concat(
        F.array(metric_row("Total entities detected", F.col("total")),
                metric_row("Unique replacements", F.col("unique"))),
        F.transform("types", lambda t: F.struct(
            F.concat(F.lit("Detected "), t["entity_type"]).alias("metric"),
            t["n"].cast("string").alias("value"))),
        F.array(*[metric_row(n, F.lit(NO_TRUTH)) for n in NO_TRUTH_METRICS]))
    return metrics_frame(gathered, lines)
