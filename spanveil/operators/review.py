"""Human review: occurrences of mapped values, the review sheet, and its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanveil.functions.text import is_yes
from spanveil.operators.skew import join_by_value
from spanveil.operators.metrics import ratio
from spanveil.operators.occurrences import occurrences
from spanveil.operators.stats import metric_row, metrics_frame


def document_text(runs: DataFrame, keys: list[str], stories: list[str] | None = None) -> DataFrame:
    """Texts of documents for review: paragraphs of the chosen stories joined by line ends."""
    rows = runs if stories is None else runs.where(F.col("story").isin(*stories))
    lines = rows.groupBy(*keys, "para_no").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("run_no", "run_text"))),
        lambda r: F.coalesce(r["run_text"], F.lit(""))), "").alias("line"))
    return lines.groupBy(*keys).agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("para_no", "line"))),
        lambda p: p["line"]), "\n").alias("text"))


def review_sheet(mapping: DataFrame, originals: DataFrame, redacted: DataFrame, order: list[str],
                 text_col: str = "text") -> DataFrame:
    """One row per mapping entry with its occurrences and a context, verdicts left blank."""
    before = occurrences(originals, mapping, order, text_col, "original", context=True
                         ).withColumnRenamed("occurrences", "original_occurrences")
    after = occurrences(redacted, mapping, order, text_col, "replacement"
                        ).withColumnRenamed("occurrences", "replacement_occurrences")
    # many originals may share a replacement
    sheet = join_by_value(mapping.select("original", "replacement"), after, "replacement").join(before, "original", "left")
    zero, blank = F.lit(0).cast("bigint"), F.lit("")
    return sheet.select(
        "original", "replacement", F.coalesce("original_occurrences", zero).alias(
            "original_occurrences"),
        F.coalesce("replacement_occurrences", zero).alias("replacement_occurrences"),
        F.coalesce("source_context", blank).alias("source_context"),
        blank.alias("is_actual_pii"), blank.alias("entity_type"), blank.alias("notes"))


def ordered_sheet(sheet: DataFrame) -> DataFrame:
    """By original, ignoring case."""
    return sheet.orderBy(F.lower("original"), "original")


def review_metrics(review: DataFrame, missed: int | None = None,
                   true_negatives: int | None = None) -> DataFrame:
    """One row of numbers from a filled-in sheet.

    An empty sheet or a blank verdict is an error. Recall and F1 need the number of
    missed values, accuracy the number of true negatives; else they are NULL.
    """
    verdict = F.coalesce("is_actual_pii", F.lit(""))
    yes = F.expr(is_yes("coalesce(is_actual_pii, '')"))
    weight = F.coalesce("original_occurrences", F.lit(1)).cast("bigint")
    counts = review.agg(
        F.count("*").alias("reviewed"), F.count_if(F.trim(verdict) == "").alias("blank"),
        F.count_if(yes).alias("tp"), F.count_if(~yes).alias("fp"),
        F.coalesce(F.sum(F.when(yes, weight)), F.lit(0)).alias("tp_occurrences"),
        F.coalesce(F.sum(F.when(~yes, weight)), F.lit(0)).alias("fp_occurrences"))
    checked = counts.withColumn("reviewed", F.when(
        F.col("reviewed") == 0, F.raise_error(F.lit("Review sheet is empty"))).when(
        F.col("blank") > 0, F.raise_error(F.lit("Every row needs is_actual_pii yes or no"))
    ).otherwise(F.col("reviewed")))
    tp, fp = F.col("tp"), F.col("fp")
    precision = ratio(tp, tp + fp)
    null = F.lit(None).cast("double")
    recall, f1, accuracy = null, null, null
    if missed is not None:
        recall = F.try_divide(tp.cast("double"), (tp + missed).cast("double"))
        f1 = ratio(2 * precision * recall, precision + recall)
    if true_negatives is not None:
        accuracy = ratio(tp + true_negatives, tp + fp + (missed or 0) + true_negatives)
    return checked.select(
        "reviewed", "tp", "fp", "tp_occurrences", "fp_occurrences", precision.alias("precision"),
        recall.alias("recall"), f1.alias("f1"), accuracy.alias("accuracy"),
        F.lit(missed).cast("bigint").alias("missed"),
        F.lit(true_negatives).cast("bigint").alias("true_negatives"))


# Wording where an input was not supplied.
NO_MISSED = "N/A (supply --missed-pii)"
NO_NEGATIVES = "N/A (supply --true-negatives)"


def review_report(metrics: DataFrame) -> DataFrame:
    """Metrics frame of a review."""
    def either(column: str, missing: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(missing))

    rows = F.array(
        metric_row("Reviewed candidates", F.col("reviewed")),
        metric_row("True positives", F.col("tp")), metric_row("False positives", F.col("fp")),
        metric_row("True-positive occurrences", F.col("tp_occurrences")),
        metric_row("False-positive occurrences", F.col("fp_occurrences")),
        metric_row("Precision", F.col("precision")),
        metric_row("Recall", either("recall", NO_MISSED)),
        metric_row("F1 Score", either("f1", NO_MISSED)),
        metric_row("Accuracy", either("accuracy", NO_NEGATIVES)),
        metric_row("Missed PII", F.col("missed")),
        metric_row("True negatives", F.col("true_negatives")))
    return metrics_frame(metrics, F.filter(rows, lambda r: r["value"].isNotNull()))
