"""End-to-end scoring against annotated texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spanveil.operators.detect import detect, explode_spans
from spanveil.operators.metrics import (
    character_accuracy, character_counts, compare_spans, span_report,
)
from spanveil.plans.redaction import keep


def score(texts: DataFrame, truth: DataFrame, keys: list[str], text_col: str = "text",
          **options) -> DataFrame:
    """Metrics frame: detect on ``texts`` and compare with ``truth`` (keys, start, end,
    entity_type). Texts without annotations count as negative."""
    detected = keep(detect(texts, text_col, **options))
    predicted = explode_spans(detected, keys)
    distinct_truth = truth.select(*keys, "start", "end", "entity_type")
    compared = compare_spans(distinct_truth, predicted, keys)
    accuracy = character_accuracy(character_counts(detected, distinct_truth, predicted, keys,
                                                   text_col))
    return span_report(compared, accuracy)
