"""Gates: the reason to turn a candidate down, or null. The first failing gate wins."""

from __future__ import annotations

from pyspark.sql import DataFrame

from spanveil.functions import dictionaries as D, patterns as P
from spanveil.functions.arrays import add_columns, is_in, literal, maximum, settle, string_array, with_ranks, with_scans
from spanveil.functions.regex import matches
from spanveil.functions.text import (
    casefold, count_tokens, digits_only, drop_article, has_letter, is_legal_reference, is_upper,
    normalize, starts_legal_reference, starts_upper, strip, strip_chars, tokens,
)
from spanveil.operators.resolve import mark
from spanveil.schema import CANDIDATES

WORDY_TYPES = ("PERSON", "ORG", "ADDRESS")
WORD_EDGE = ".,;:()"


def is_public_organization(normalized: str) -> str:
    return (f"({is_in(normalized, D.PUBLIC_ORGANIZATIONS)} "
            f"OR {is_in(drop_article(normalized), D.PUBLIC_ORGANIZATIONS)})")


def is_protected_term(normalized: str) -> str:
    return (f"({is_in(normalized, D.PROTECTED_TERMS)} "
            f"OR {is_in(drop_article(normalized), D.PROTECTED_TERMS)} "
            f"OR {is_legal_reference(normalized)})")


def is_generic(normalized: str) -> str:
    bare = strip_chars(normalized, " :;,.\\/()")
    return f"({is_in(bare, D.GENERIC_TERMS)} OR {starts_legal_reference(bare)})"


def is_heading(value: str) -> str:
    """At least two words, all in upper case."""
    return f"(regexp_count({value}, '[A-Za-z]+') >= 2 AND {is_upper(value)})"


def dictionary_cases(normalized: str) -> str:
    return (f"WHEN {is_public_organization(normalized)} THEN 'public_organization' "
            f"WHEN {is_protected_term(normalized)} THEN 'protected_term'")


# The end that reaches farthest, its source, and the farthest end of any other source.
_REACH = "STRUCT<far: INT, source: STRING, other: INT>"


def _farther(so_far: str, x: str) -> str:
    return (f"CASE WHEN {x}.source <=> {so_far}.source THEN named_struct('far', greatest({so_far}.far, {x}.far), "
            f"'source', {so_far}.source, 'other', {so_far}.other) "
            f"WHEN {x}.far > {so_far}.far THEN named_struct('far', {x}.far, 'source', {x}.source, 'other', {so_far}.far) "
            f"ELSE named_struct('far', {so_far}.far, 'source', {so_far}.source, 'other', greatest({so_far}.other, {x}.far)) END")


def with_touched(df: DataFrame, spans: str, others: str, output: str, other_source: bool = False) -> DataFrame:
    """Add, for each of ``spans``, whether it shares a character with any of ``others``: ARRAY<BOOLEAN>.

    With ``other_source`` only those of another source count. Null where ``others`` is
    empty. A sweep: in the order of their starts, those that start before a span's end
    are a prefix of the others, and one of them touches the span if the farthest end in
    the prefix lies behind the span's start.
    """
    there = f"size({others}) > 0 AND size({spans}) > 0"
    df = add_columns(df, {"_sorted": (
        f"if({there}, sort_array(transform({others}, o -> named_struct('start', o.start, 'end', o.end"
        f"{', ' + chr(39) + 'source' + chr(39) + ', o.source' if other_source else ''}))), NULL)")})
    df = with_ranks(df, {"_rank": (f"if({there}, transform({spans}, s -> s.end), NULL)",
                                   "transform(_sorted, o -> o.start)", "<")})
    # one more element, so that the scan also has what all of them reach
    if other_source:
        zero = f"CAST(named_struct('far', -1, 'source', NULL, 'other', -1) AS {_REACH})"
        ends = "transform(_sorted, o -> named_struct('far', o.end, 'source', o.source))"
        df = with_scans(df, {"_reach": f"concat({ends}, slice({ends}, 1, 1))"}, zero, _farther, _REACH)
        reach = ("zip_with({spans}, transform(_rank, r -> _reach[r]), (s, t) -> "
                 "if(t.source <=> s.source, t.other, t.far) > s.start)")
    else:
        df = with_scans(df, {"_reach": "concat(transform(_sorted, o -> o.end), array(0))"}, -1, maximum)
        reach = "zip_with({spans}, transform(_rank, r -> _reach[r]), (s, t) -> t > s.start)"
    # named twice, _reach is computed once and not again for each element
    return add_columns(df, {output: f"if(_reach IS NULL, NULL, {reach.format(spans=spans)})"}).drop("_sorted", "_rank", "_reach")


def apply_validity(df: DataFrame, candidates: str, protected: str, output: str) -> DataFrame:
    """Strip every value, then run the gates that look at the value itself."""
    df = add_columns(df, {"_stripped": (
        f"transform({candidates}, c -> named_struct('start', c.start, 'end', c.end, "
        f"'text', {strip('c.text')}, 'entity_type', c.entity_type, 'score', c.score, "
        f"'source', c.source, 'reason', c.reason, 'norm', {normalize('c.text')}))")})
    df = with_touched(df, "_stripped", protected, "_protects")
    wordy = is_in("c.entity_type", WORDY_TYPES)
    cases = f"""CASE
        WHEN c.reason IS NOT NULL THEN c.reason
        WHEN c.text = '' THEN 'empty'
        WHEN t THEN 'protected_span_skipped'
        WHEN c.entity_type = 'PHONE' AND length({digits_only('c.text')}) < 10
            THEN 'short_numeric_fragment'
        WHEN {wordy} AND NOT rlike(c.text, '[A-Za-z]') THEN 'numeric_fragment'
        WHEN {wordy} AND length(c.text) <= 5 AND {is_upper('c.text')}
            AND {count_tokens('c.text')} = 1 THEN 'short_abbreviation'
        {dictionary_cases('c.norm')}
        WHEN {is_generic('c.norm')} OR (c.source <> 'regex' AND {is_heading('c.text')})
            THEN 'blacklist'
        WHEN c.entity_type = 'ORG' AND c.source = 'regex' AND {count_tokens('c.text')} < 2
            THEN 'org_single_word'
        END"""
    return add_columns(df, {output: (
        f"CAST(zip_with(_stripped, coalesce(_protects, CAST(array() AS ARRAY<BOOLEAN>)), (c, t) -> {mark('c', cases)}) "
        f"AS {CANDIDATES})")}).drop("_stripped", "_protects")


def threshold(c: str, confidence: float, source_thresholds: dict[str, float],
              type_thresholds: dict[str, float]) -> str:
    """The highest of the source, the global and the type threshold."""
    def lookup(key: str, table: dict[str, float]) -> str:
        cases = " ".join(f"WHEN {literal(n)} THEN {float(v)!r}D" for n, v in table.items())
        return f"CASE {key} {cases} ELSE {float(confidence)!r}D END"
    return (f"greatest({lookup(c + '.source', source_thresholds)}, {float(confidence)!r}D, "
            f"{lookup(c + '.entity_type', type_thresholds)})")


def apply_confidence(df: DataFrame, candidates: str, output: str, *,
                     confidence: float = D.DEFAULT_CONFIDENCE,
                     thresholds: dict[str, float] | None = None,
                     source_thresholds: dict[str, float] | None = None,
                     recheck: bool = False) -> DataFrame:
    """Turn down scores below the threshold.

    ``recheck`` repeats the dictionary gates, for spans that did not come through
    ``apply_validity`` (for others it cannot find anything new).
    """
    bar = threshold("c", confidence, {**D.SOURCE_THRESHOLDS, **(source_thresholds or {})},
                    {**D.TYPE_THRESHOLDS, **(thresholds or {})})
    more = dictionary_cases(normalize("c.text")) if recheck else ""
    cases = f"CASE WHEN c.score < {bar} THEN 'confidence' {more} END"
    return add_columns(df, {output: (
        f"CAST(transform({candidates}, c -> {mark('c', cases)}) AS {CANDIDATES})")})


def has_company_suffix(value: str) -> str:
    return f"rlike({value}, {literal(matches(P.COMPANY_SUFFIX))})"


def apply_semantics(df: DataFrame, candidates: str, output: str) -> DataFrame:
    """Rules for PERSON and ORG.

    An organisation without a legal suffix needs an overlapping organisation from
    another source that passed the confidence gate.
    """
    df = settle(df, {"_orgs": (
        f"filter({candidates}, c -> c.reason IS NULL AND c.entity_type = 'ORG')")})
    df = with_touched(df, candidates, "_orgs", "_backed", other_source=True)
    n = count_tokens("c.text")
    bare = f"transform({tokens('c.text')}, w -> {strip_chars(casefold('w'), WORD_EDGE)})"
    lettered = f"filter({tokens('c.text')}, w -> {has_letter('w')})"
    titled = f"exists({lettered}, w -> {starts_upper('w')})"
    role = " OR ".join(f"contains({casefold('c.text')}, {literal(w)})" for w in D.ROLE_WORDS)
    prosaic = (f"({is_in(f'coalesce(get({bare}, 0), {literal(chr(0))})', D.PROSE_WORDS)} "
               f"OR size(array_intersect({bare}, {string_array(D.PROSE_WORDS)})) >= 2)")
    cases = f"""CASE
        WHEN c.reason IS NOT NULL THEN c.reason
        WHEN c.entity_type = 'PERSON' THEN CASE
            WHEN {n} < 2 AND ({role}) THEN 'person_role_word'
            WHEN arrays_overlap({bare}, {string_array(D.ADDRESS_WORDS)})
                THEN 'person_address_fragment'
            WHEN {n} < 2 AND c.score < {D.SINGLE_WORD_PERSON_SCORE}D THEN 'person_single_word'
            WHEN size({lettered}) >= 2 AND NOT {titled} THEN 'person_not_titlecase' END
        WHEN c.entity_type = 'ORG' AND {has_company_suffix('c.text')} THEN
            if({prosaic}, 'org_prose_span', NULL)
        WHEN c.entity_type = 'ORG' THEN CASE
            WHEN NOT ({n} BETWEEN 2 AND 5) OR NOT coalesce(t, false) THEN 'org_weak'
            WHEN NOT {titled} THEN 'org_not_titlecase' END
        END"""
    return add_columns(df, {output: (
        f"CAST(zip_with({candidates}, coalesce(_backed, CAST(array() AS ARRAY<BOOLEAN>)), (c, t) -> {mark('c', cases)}) "
        f"AS {CANDIDATES})")}).drop("_orgs", "_backed")
