"""Spans of external models (named-entity taggers, analyzers) as candidates."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from spanveil.functions import dictionaries as D
from spanveil.functions.arrays import literal, settle
from spanveil.functions.text import casefold
from spanveil.schema import CANDIDATES, RAW_SPANS


def model_spans(text: Column, load: Callable[[], Callable[[list[str]], list[list[tuple]]]]) -> Column:
    """Run a model over a text column: ARRAY<STRUCT<start, end, text, label, score>>.

    ``load`` is called once per task and returns ``predict(texts)``, which gives for
    each text a list of (start, end, label, score). Only the text crosses to Python.
    """

    @F.pandas_udf(RAW_SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for batch in batches:
            texts = batch.fillna("").tolist()
            yield pd.Series([
                [{"start": int(s), "end": int(e), "text": text[s:e], "label": label,
                  "score": float(score)} for s, e, label, score in spans]
                for text, spans in zip(texts, predict(texts))])

    return run(text)


def attach_spans(texts: DataFrame, spans: DataFrame, key: str | list[str], text_col: str = "text",
                 output: str = "raw_spans") -> DataFrame:
    """Join a table of externally scored spans (key.., start, end, label, score) to texts.

    A group holds the spans of one text only, so its size is bounded by the text.
    """
    keys = [key] if isinstance(key, str) else list(key)
    grouped = spans.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(
        "start", "end", "label", "score"))).alias(output))
    joined = texts.join(grouped, keys, "left")
    return joined.withColumn(output, F.transform(
        F.coalesce(output, F.array().cast("array<struct<start:int,end:int,label:string,score:double>>")),
        lambda s: F.struct(
            s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end"),
            F.substring(F.col(text_col), s["start"] + 1, s["end"] - s["start"]).alias("text"),
            s["label"].alias("label"), s["score"].cast("double").alias("score"))))


def _as_candidates(raw: str, labels: dict[str, str], source: str, score: str) -> str:
    cases = " ".join(f"WHEN {literal(n)} THEN {literal(t)}" for n, t in labels.items())
    typed = (f"transform({raw}, s -> named_struct('start', s.start, 'end', s.end, 'text', s.text, "
             f"'entity_type', CASE s.label {cases} END, 'score', {score}, "
             f"'source', {literal(source)}, 'reason', CAST(NULL AS STRING)))")
    return f"CAST(filter({typed}, c -> c.entity_type IS NOT NULL) AS {CANDIDATES})"


def ner_candidates(df: DataFrame, raw: str, output: str,
                   score: float = D.NER_SCORE) -> DataFrame:
    """Named-entity spans: labels PERSON and ORG only, one fixed score, source ``spacy``."""
    return settle(df, {output: _as_candidates(raw, D.NER_LABELS, "spacy", f"{float(score)!r}D")})


def address_context(text: str, start: str, end: str) -> str:
    """Address vocabulary within 80 characters of the span."""
    left = f"greatest({start} - {D.LOCATION_RADIUS}, 0)"
    window = f"substring({text}, {left} + 1, {end} + {D.LOCATION_RADIUS} - {left})"
    return f"rlike({casefold(window)}, {literal('|'.join(D.LOCATION_CONTEXT))})"


def analyzer_candidates(df: DataFrame, raw: str, output: str, text: str = "text",
                        min_score: float = D.ANALYZER_MIN_SCORE) -> DataFrame:
    """Analyzer spans, source ``presidio``: known labels, score at least ``min_score``, and
    locations only beside address vocabulary."""
    typed = _as_candidates(raw, D.ANALYZER_LABELS, "presidio", "s.score")
    return settle(df, {output: (
        f"filter({typed}, c -> c.score >= {float(min_score)!r}D AND (c.entity_type <> 'ADDRESS' "
        f"OR {address_context(text, 'c.start', 'c.end')}))")})
