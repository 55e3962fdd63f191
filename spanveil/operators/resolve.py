"""Deduplication, overlap resolution and frequency suppression inside one text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from spanveil.functions import dictionaries as D
from spanveil.functions.arrays import add_columns, indexes, let, literal, maximum, with_ranks, with_scans
from spanveil.functions.text import casefold, overlap
from spanveil.schema import CANDIDATES

FIELDS = ("start", "end", "text", "entity_type", "score", "source")


def open_ones(candidates: str) -> str:
    return f"filter({candidates}, c -> c.reason IS NULL)"


def closed_ones(candidates: str) -> str:
    return f"filter({candidates}, c -> c.reason IS NOT NULL)"


def mark(c: str, reason: str) -> str:
    """A candidate with its reason set, if it has none yet."""
    fields = ", ".join(f"'{f}', {c}.{f}" for f in FIELDS)
    return f"named_struct({fields}, 'reason', coalesce({c}.reason, {reason}))"


def source_rank(source: str) -> str:
    cases = " ".join(f"WHEN {literal(n)} THEN {rank}" for n, rank in D.SOURCE_RANK.items())
    return f"CASE {source} {cases} ELSE 0 END"


def dedupe(df: DataFrame, candidates: str, output: str) -> DataFrame:
    """Mark all but the best of the candidates with equal (start, end) as ``duplicate``.

    Best = highest score, then source rank, then first. The result is ordered by
    (start, end). One native sort, then each element looks at its predecessor.
    """
    df = add_columns(df, {"_ranked": (
        f"sort_array(transform({candidates}, (c, i) -> named_struct('start', c.start, "
        f"'end', c.end, 'by_score', -c.score, 'by_rank', -({source_rank('c.source')}), "
        f"'by_order', i, 'c', c)))")})
    before = "_ranked[greatest(i - 1, 0)]"
    return add_columns(df, {output: (
        f"transform(_ranked, (x, i) -> {mark('x.c', f'''if(i > 0 AND {before}.start = x.start
        AND {before}.end = x.end, 'duplicate', NULL)''')})")}).drop("_ranked")


# Sort keys of the greedy choice: score, length, position; or length, position.
BEST_FIRST = "'k1', -c.score, 'k2', c.start - c.end, 'k3', c.start"
LONGEST_FIRST = "'k2', c.start - c.end, 'k3', c.start"


#: Cells of an island have about the square root of its size, and at least so many candidates.
LEAST_CELL = 32


def resolve_overlaps(df: DataFrame, candidates: str, output: str, *, key: str = BEST_FIRST,
                     element: str = CANDIDATES, marked: Callable[[str, str], str] = mark) -> DataFrame:
    """Greedy choice of non-overlapping candidates; losers are marked ``overlap``.

    Expects open candidates ordered by (start, end). With ``to`` = how many candidates start
    before the end of one, two of them overlap exactly if each has its place before the other's
    ``to``: positions are no longer needed. A choice only depends on candidates that are linked
    by a chain of overlaps, so the array is cut into such islands; a large island is cut into cells
    of places, and a candidate is compared only with those kept in the cells that it
    reaches, which are few because kept ones do not overlap. A chain of n costs n * sqrt(n) at
    most. Texts without any overlap (most) skip all of it, and texts whose islands have at most
    ``LEAST_CELL`` candidates compare them directly, with the same result.
    """
    previous = f"{candidates}[greatest(i - 1, 0)]"
    df = add_columns(df, {"_touch": (
        f"exists({indexes(f'size({candidates})')}, i -> i > 0 "
        f"AND {candidates}[i].start < {previous}.end)")})
    df = with_scans(df, {"_reach": f"if(_touch, transform({candidates}, c -> c.end), NULL)"}, -1, maximum)
    df = add_columns(df, {"_heads": (
        f"filter(transform(zip_with({candidates}, _reach, (c, r) -> c.start >= r), "
        "(first, i) -> if(first, i, -1)), i -> i >= 0)")})
    size = f"(coalesce(get(_heads, j + 1), size({candidates})) - b)"
    df = add_columns(df, {"_long": f"exists(transform(_heads, (b, j) -> {size}), n -> n > {LEAST_CELL})"})
    df = with_ranks(df, {"_to": (f"if(_long, transform({candidates}, c -> c.end), NULL)",
                                 f"if(_long, transform({candidates}, c -> c.start), NULL)", "<")})
    df = add_columns(df, {"_keyed": f"zip_with({candidates}, _to, (c, t) -> named_struct({key}, 'to', t))"})
    cell = lambda place, side: f"CAST(({place}) DIV {side} AS INT)"
    df = add_columns(df, {
        "_islands": f"transform(_heads, (b, j) -> slice({candidates}, b + 1, {size}))",
        "_sides": f"if(_long, transform(_heads, (b, j) -> greatest({LEAST_CELL}, CAST(ceil(sqrt({size})) AS INT))), NULL)"})
    df = add_columns(df, {"_turns": let("keyed", "_keyed", (
        f"transform(if(keyed IS NULL, NULL, _heads), (b, j) -> transform(slice(keyed, b + 1, {size}), "
        "(x, i) -> named_struct('x', x, 'i', i, 'to', x.to - b)))"))})
    df = add_columns(df, {"_turns": (
        f"zip_with(_turns, _sides, (t, side) -> sort_array(transform(t, x -> named_struct('x', x.x, 'i', x.i, 'to', x.to, "
        f"'first', {cell('x.i', 'side')}, 'last', {cell('greatest(x.to - 1, x.i)', 'side')}, "
        f"'both', shiftleft(CAST(x.i AS BIGINT), 32) + x.to))))")})
    # A kept candidate is one number, place and ``to``: structs would be cast at each step.
    reached = "slice(kept, x.first + 1, x.last - x.first + 1)"
    df = add_columns(df, {"_cells": (
        f"transform(_turns, t -> if(size(t) = 1, NULL, aggregate(t, "
        f"array_repeat(CAST(array() AS ARRAY<BIGINT>), array_max(transform(t, x -> x.last)) + 1), (kept, x) -> "
        f"if(exists({reached}, g -> exists(g, k -> shiftright(k, 32) < x.to AND x.i < (k & 4294967295))), kept, "
        f"concat(slice(kept, 1, x.first), transform({reached}, g -> array_append(g, x.both)), "
        f"slice(kept, x.last + 2, size(kept)))))))")})
    df = add_columns(df, {"_kept": (
        f"zip_with(_cells, _sides, (cells, side) -> if(cells IS NULL, NULL, named_struct('side', side, "
        f"'cells', transform(cells, g -> transform(g, k -> CAST(shiftright(k, 32) AS INT))))))")})
    reason = f"if(array_contains(kept.cells[{cell('i', 'kept.side')}], i), NULL, 'overlap')"
    direct = f"if(exists(acc, k -> k.reason IS NULL AND {overlap('k', 'x.c')}), 'overlap', NULL)"
    greedy = (f"sort_array(aggregate(sort_array(transform(g, c -> named_struct({key}, 'c', c))), "
              f"CAST(array() AS {element}), (acc, x) -> array_append(acc, {marked('x.c', direct)})))")
    df = add_columns(df, {output: (
        f"CASE WHEN _long THEN flatten(zip_with(_islands, _kept, (g, kept) -> if(kept IS NULL, CAST(g AS {element}), "
        f"transform(g, (c, i) -> {marked('c', reason)})))) "
        f"WHEN _touch THEN flatten(transform(_islands, g -> if(size(g) = 1, CAST(g AS {element}), {greedy}))) "
        f"ELSE CAST({candidates} AS {element}) END")})
    return df.drop("_touch", "_reach", "_heads", "_long", "_to", "_keyed", "_islands", "_sides", "_turns", "_cells", "_kept")


def suppress_frequent(df: DataFrame, candidates: str, output: str,
                      limit: int = D.FREQUENCY_LIMIT) -> DataFrame:
    """Mark PERSON/ORG values that occur more than ``limit`` times among the candidates.

    In the sorted array of values a value is frequent exactly if it also stands
    ``limit`` places further on.
    """
    df = add_columns(df, {"_names": (
        f"if(size({candidates}) > {limit}, "
        f"sort_array(transform({candidates}, c -> {casefold('c.text')})), NULL)")})
    df = add_columns(df, {"_often": (
        f"array_distinct(filter(_names, (v, i) -> coalesce(get(_names, i + {limit}) = v, false)))")})
    frequent = (f"if(c.entity_type IN ('PERSON', 'ORG') AND c.score < {D.FREQUENCY_SCORE}D "
                f"AND array_contains(_often, {casefold('c.text')}), 'frequency_suppressed', NULL)")
    return add_columns(df, {output: (
        f"if(_often IS NULL, {candidates}, transform({candidates}, c -> {mark('c', frequent)}))")
    }).drop("_names", "_often")
