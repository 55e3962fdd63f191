"""Protected phrases: spans that must stay as they are."""

from __future__ import annotations

import re
from collections.abc import Iterable
from itertools import groupby

from pyspark.sql import DataFrame

from spanveil.functions import dictionaries as D
from spanveil.functions.arrays import add_columns, settle
from spanveil.functions.regex import SPACE, with_found_everywhere
from spanveil.functions.text import overlap
from spanveil.operators.resolve import LONGEST_FIRST, resolve_overlaps
from spanveil.schema import INTERVALS

PHRASES = tuple(dict.fromkeys(D.PROTECTED_TERMS + D.PUBLIC_ORGANIZATIONS))
_PLACES = "array<struct<start:int,end:int,reason:string>>"


def _levels(phrases: Iterable[str]) -> list[list[str]]:
    """Phrases by the number of other phrases they start with.

    Two phrases can match at the same place only if one starts with the other, so
    within one level at most one phrase matches at a place and a single
    alternation loses nothing.
    """
    levels: dict[int, list[str]] = {}
    phrases = sorted(set(phrases))
    for phrase in phrases:
        depth = sum(phrase != other and phrase.startswith(other) for other in phrases)
        levels.setdefault(depth, []).append(phrase)
    return [levels[d] for d in sorted(levels)]


def _alternation(phrases: list[str]) -> str:
    """One alternative per first letter, so that most places fail at once."""
    def tail(phrase: str) -> str:
        return f"{SPACE}+".join(re.sub(r"([^A-Za-z0-9])", r"\\\1", w) for w in phrase[1:].split(" "))
    return "|".join(
        re.escape(first) + "(?:" + "|".join(tail(p) for p in group) + ")"
        for first, group in groupby(sorted(phrases), key=lambda p: p[0]))


def with_protected(df: DataFrame, text: str = "text", *, output: str = "protected",
                   condition: str = "true", phrases: Iterable[str] = PHRASES) -> DataFrame:
    """Add the protected phrases that do not overlap: ARRAY<STRUCT<start, end>>.

    Every phrase is looked for at every place; then longer ones go first, and
    among equally long ones the leftmost.
    """
    bodies = {f"_level_{i}": _alternation(level) for i, level in enumerate(_levels(phrases))}
    df = with_found_everywhere(df, text, bodies, condition)
    df = add_columns(df, {"_places": (
        f"if({condition}, sort_array(array_distinct(transform(concat({', '.join(bodies)}), "
        f"s -> named_struct('start', s.start, 'end', s.end, 'reason', CAST(NULL AS STRING))))), "
        f"CAST(array() AS {_PLACES}))")})
    df = resolve_overlaps(df, "_places", "_settled", key=LONGEST_FIRST, element=_PLACES,
                          marked=lambda c, reason: (
                              f"named_struct('start', {c}.start, 'end', {c}.end, 'reason', {reason})"))
    return settle(df, {output: (
        f"CAST(transform(filter(_settled, s -> s.reason IS NULL), "
        f"s -> named_struct('start', s.start, 'end', s.end)) AS {INTERVALS})")
    }).drop(*bodies, "_places", "_settled")
