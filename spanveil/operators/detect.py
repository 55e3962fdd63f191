"""Detection: text -> accepted spans, row by row, without a shuffle.

The chain is a sequence of projections, one array column per step. Each step is
used more than once by the next, which keeps the optimizer from inlining (and so
repeating) it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanveil.functions import dictionaries as D
from spanveil.functions.arrays import add_columns, literal, settle
from spanveil.functions.regex import NOT_SPACE
from spanveil.operators.gates import apply_confidence, apply_semantics, apply_validity
from spanveil.operators.protected import PHRASES, with_protected
from spanveil.operators.recognizers import recognize
from spanveil.operators.resolve import (
    closed_ones, dedupe, open_ones, resolve_overlaps, suppress_frequent,
)
from spanveil.operators.skew import join_salted
from spanveil.schema import CANDIDATES, SPANS


def with_candidates(df: DataFrame, text: str, external: list[str] | None = None,
                    recognizers: list[str] | None = None, phrases=PHRASES) -> DataFrame:
    """Add ``_found`` (all candidates) and ``_protected`` (phrase spans, only where needed)."""
    df = recognize(df, text, output="_found", names=recognizers)
    if external:
        parts = ", ".join(f"coalesce({e}, CAST(array() AS {CANDIDATES}))" for e in external)
        df = add_columns(df, {"_found": (
            f"if(rlike({text}, {literal(NOT_SPACE)}), concat(_found, {parts}), _found)")})
    return with_protected(df, text, output="_protected", condition="size(_found) > 0",
                          phrases=phrases)


def judge(df: DataFrame, *, confidence: float = D.DEFAULT_CONFIDENCE,
          thresholds: dict[str, float] | None = None,
          source_thresholds: dict[str, float] | None = None,
          frequency_limit: int = D.FREQUENCY_LIMIT, recheck: bool = False) -> DataFrame:
    """Replace ``_found`` and ``_protected`` by ``_judged``: every candidate with its fate."""
    df = apply_validity(df, "_found", "_protected", "_valid")
    df = apply_confidence(df, "_valid", "_sure", confidence=confidence, thresholds=thresholds,
                          source_thresholds=source_thresholds, recheck=recheck)
    df = apply_semantics(df, "_sure", "_gated")
    df = add_columns(df, {"_open": open_ones("_gated")})
    df = suppress_frequent(df, "_open", "_counted", frequency_limit)
    df = add_columns(df, {"_rare": open_ones("_counted")})
    df = dedupe(df, "_rare", "_unique")
    df = add_columns(df, {"_single": open_ones("_unique")})
    df = resolve_overlaps(df, "_single", "_settled")
    df = add_columns(df, {"_judged": f"concat({closed_ones('_gated')}, {closed_ones('_counted')}, "
                                     f"{closed_ones('_unique')}, _settled)"})
    return df.drop("_found", "_protected", "_valid", "_sure", "_gated", "_open", "_counted",
                   "_rare", "_unique", "_single", "_settled")


def accepted(judged: str) -> str:
    """The spans that were kept, ordered by position: ARRAY<SPAN>."""
    return (f"CAST(transform({open_ones(judged)}, c -> named_struct('start', c.start, 'end', c.end, "
            "'text', c.text, 'entity_type', c.entity_type, 'score', c.score, 'source', c.source)) "
            f"AS {SPANS})")


def detect(df: DataFrame, text_col: str = "text", *, output: str = "spans",
           external: list[str] | None = None, rejected: str | None = None,
           recognizers: list[str] | None = None, phrases=PHRASES, **options) -> DataFrame:
    """Add the accepted spans of ``text_col`` as column ``output``: ARRAY<SPAN>.

    external: columns with candidates from ``external.ner_candidates`` / ``analyzer_candidates``.
    rejected: name of a further column for the candidates that were turned down.
    recognizers: names of the pattern recognizers to run (default all).
    options: confidence, thresholds, source_thresholds, frequency_limit, recheck (the dictionary
    gates once more on what passed the confidence gate).
    """
    judged = judge(with_candidates(df, text_col, external, recognizers, phrases), **options)
    columns = {output: accepted("_judged")}
    if rejected:
        columns[rejected] = closed_ones("_judged")
    return settle(judged, columns).drop("_judged")


def explode_spans(df: DataFrame, keys: list[str], spans: str = "spans") -> DataFrame:
    """Table form: one row per span."""
    return df.select(*keys, F.inline_outer(spans)).where(F.col("start").isNotNull())


def explode_fates(df: DataFrame, keys: list[str], spans: str = "spans",
                  rejected: str = "rejected") -> DataFrame:
    """One row per candidate: span fields and reason (``kept`` for accepted spans)."""
    every = F.expr(
        f"concat({rejected}, transform({spans}, s -> named_struct('start', s.start, 'end', s.end, "
        f"'text', s.text, 'entity_type', s.entity_type, 'score', s.score, 'source', s.source, "
        f"'reason', 'kept')))")
    return df.select(*keys, F.inline_outer(every)).where(F.col("start").isNotNull())


def detect_distinct(df: DataFrame, key_cols: list[str], text_col: str = "text", *,
                    output: str = "spans", **options) -> DataFrame:
    """Detect once per distinct text instead of once per row.

    Worth it when texts repeat often and are long to scan. Texts are told apart by their
    SHA-256 and length, so that rows meet their spans on 40 bytes; copies of one text are spread
    over as many salts as their measured number asks for (``skew.join_salted``), by row key.
    """
    known = F.struct(F.sha2(text_col, 256).alias("hash"), F.length(text_col).alias("length"))
    digested = df.withColumn("_text", known)
    once = detect(digested.where(F.col(text_col).isNotNull()).select("_text", text_col).dropDuplicates(["_text"]),
                  text_col, output=output, **options)
    return join_salted(digested, once.select("_text", output), "_text", by=key_cols).drop("_text").withColumn(
        output, F.coalesce(output, F.array().cast(SPANS)))
