"""Scoring of predicted spans against annotated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spanveil.functions.text import to_sorted_json
from spanveil.operators.stats import metric_row, metrics_frame


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division with 0 for a zero denominator."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return ratio(2 * tp, 2 * tp + fp + fn)


def compare_spans(truth: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """One row per distinct (keys, start, end, entity_type) with in_truth / in_predicted.

    A grouped union instead of a full outer join: one shuffle, with the duplicates
    of each task removed before it.
    """
    columns = [*keys, "start", "end", "entity_type"]
    both = truth.select(*columns, F.lit(True).alias("t"), F.lit(False).alias("p")).unionByName(
        predicted.select(*columns, F.lit(False).alias("t"), F.lit(True).alias("p")))
    return both.groupBy(*columns).agg(F.max("t").alias("in_truth"), F.max("p").alias("in_predicted"))


def match_counts(compared: DataFrame, by: list[str] | None = None) -> DataFrame:
    """True positives, false positives, false negatives, also per group."""
    t, p = F.col("in_truth"), F.col("in_predicted")
    return compared.groupBy(*(by or [])).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"))


def exact_metrics(compared: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return match_counts(compared).select(
        "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), f1(tp, fp, fn).alias("f1"))


#: Positions of one text that one task sweeps; a text has at most 32,768 such blocks.
SWEEP = 1 << 16


def _invalid(bad: Column, start: Column, end: Column, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.concat_ws(
        " ", F.lit("Invalid entity span:"), start, end))).otherwise(value)


def character_counts(texts: DataFrame, truth: DataFrame, predicted: DataFrame, keys: list[str],
                     text_col: str = "text", *, sweep: int = SWEEP) -> DataFrame:
    """One row: characters, and those on which both sides agree (covered by any span or not).

    Spans become +1/-1 events per position, and a running sum gives the cover between two
    positions. The sum has two levels: blocks of ``sweep`` positions are added up apart, and
    each block starts from the total of those before it, so that a text with millions of
    spans is swept by many tasks. Nothing grows with the number of characters.
    Spans outside their text, or of no text, raise an error.
    """
    start, end = F.col("start"), F.col("end")
    lengths = texts.select(*keys, F.length(text_col).alias("_len"))
    spans = truth.select(*keys, "start", "end", F.lit(1).alias("t"), F.lit(0).alias("p")).unionByName(
        predicted.select(*keys, "start", "end", F.lit(0).alias("t"), F.lit(1).alias("p")))
    zero = F.lit(0).cast("bigint")
    events = spans.withColumn("start", _invalid((start < 0) | (end < start), start, end, start)).select(
        *keys, F.inline(F.array(
            F.struct(F.col("start").alias("pos"), "t", "p"),
            F.struct(F.col("end").alias("pos"), (-F.col("t")).alias("t"), (-F.col("p")).alias("p")))))
    # Read twice with the same columns, so that Spark computes the spans and shuffles them once.
    steps = events.groupBy(*keys, F.floor(F.col("pos") / sweep).alias("_block"), "pos").agg(
        F.sum("t").alias("t"), F.sum("p").alias("p"))
    across = Window.partitionBy(*keys).orderBy("_block")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    blocks = steps.groupBy(*keys, "_block").agg(
        F.sum("t").alias("t"), F.sum("p").alias("p"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    beyond = F.col("_len").isNull() | (F.col("last") > F.col("_len"))  # or of a text that is not there
    carried = blocks.join(lengths, keys, "left").select(
        *keys, "_block", _invalid(beyond, F.col("last"), F.lit("is not inside its text"), F.coalesce(
            F.sum("t").over(before), zero)).alias("_t"),
        F.coalesce(F.sum("p").over(before), zero).alias("_p"), F.lead("first").over(across).alias("_next"))
    inside = Window.partitionBy(*keys, "_block").orderBy("pos")
    covered = steps.join(carried, [*keys, "_block"]).select(
        (F.sum("t").over(inside) + F.col("_t") > 0).alias("t"),
        (F.sum("p").over(inside) + F.col("_p") > 0).alias("p"),
        (F.coalesce(F.lead("pos").over(inside), "_next") - F.col("pos")).alias("n"))
    differ = covered.agg(F.sum(F.when(F.col("t") != F.col("p"), F.col("n"))).alias("differ"))
    parts = lengths.agg(F.sum("_len").alias("characters")).withColumn("differ", zero).unionByName(
        differ.withColumn("characters", zero))
    return parts.agg(F.coalesce(F.sum("characters"), zero).alias("characters"),
                     F.coalesce(F.sum("differ"), zero).alias("differ")).select(
        "characters", (F.col("characters") - F.col("differ")).alias("agree"))


def character_accuracy(counts: DataFrame) -> DataFrame:
    """One row: accuracy; NULL without any character."""
    return counts.select("characters", "agree", F.try_divide(
        F.col("agree").cast("double"), F.col("characters").cast("double")).alias("accuracy"))


def type_totals(compared: DataFrame) -> DataFrame:
    """Annotated and predicted distinct spans per type."""
    return compared.groupBy("entity_type").agg(
        F.count_if("in_truth").alias("truth"), F.count_if("in_predicted").alias("predicted"))


def span_report(compared: DataFrame, accuracy: DataFrame) -> DataFrame:
    """Metrics frame of a scored run; dictionaries as JSON with sorted keys."""
    zero = F.lit(0).cast("bigint")
    per_type = match_counts(compared, ["entity_type"]).withColumn(
        "accuracy", F.lit(None).cast("double"))
    extra = accuracy.select(
        F.lit(None).cast("string").alias("entity_type"), zero.alias("tp"), zero.alias("fp"),
        zero.alias("fn"), "accuracy")

    def counts(other: str) -> Column:
        n = F.col("tp") + F.col(other)
        return F.collect_list(F.when(n > 0, F.struct(
            F.col("entity_type").alias("key"), n.alias("value"))))

    one = per_type.unionByName(extra).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.max("accuracy").alias("accuracy"), counts("fn").alias("truths"),
        counts("fp").alias("predictions"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return metrics_frame(one, F.array(
        metric_row("Total ground-truth entities", tp + fn),
        metric_row("Total detected entities", tp + fp), metric_row("True positives", tp),
        metric_row("False positives", fp), metric_row("False negatives", fn),
        metric_row("Precision", ratio(tp, tp + fp)), metric_row("Recall", ratio(tp, tp + fn)),
        metric_row("F1 Score", f1(tp, fp, fn)), metric_row("Accuracy", F.col("accuracy")),
        metric_row("Ground-truth entity counts", F.expr(to_sorted_json("truths"))),
        metric_row("Detected entity counts", F.expr(to_sorted_json("predictions")))))


def binary_counts(pairs: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Cells of the 2x2 table over 0/1 columns; a missing label is an error."""
    missing = F.col(truth).isNull() | F.col(predicted).isNull()
    t = F.when(missing, F.raise_error(F.lit("every row needs both labels"))).otherwise(
        F.col(truth) == 1)
    p = F.col(predicted) == 1
    return pairs.agg(
        F.count("*").alias("total"), F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))


def binary_metrics(counts: DataFrame) -> DataFrame:
    """One row: accuracy, precision, recall, f1 (0 where undefined)."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        "total", "fp", "fn", ratio(tp + tn, F.col("total")).alias("accuracy"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        f1(tp, fp, fn).alias("f1"))


def binary_report(metrics: DataFrame) -> DataFrame:
    """Metrics frame of a labelled experiment."""
    names = {"Accuracy": "accuracy", "Precision": "precision", "Recall": "recall",
             "F1 Score": "f1", "Total entities evaluated": "total", "False positives": "fp",
             "False negatives": "fn"}
    return metrics_frame(metrics, F.array(*[metric_row(n, F.col(c)) for n, c in names.items()]))
