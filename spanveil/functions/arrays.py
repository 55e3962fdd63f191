"""Array expressions built from higher-order functions, as Spark SQL text.

Expressions are written as SQL text: one call builds a whole lambda tree. Spark
types a higher-order function by asking its body, several times per nesting level,
so expressions stay shallow and multi-step ones add one column per step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

BLOCK = 256


def literal(value: str | None) -> str:
    """A SQL string literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def is_in(expr: str, words) -> str:
    return f"({expr} IN ({', '.join(map(literal, words))}))"


def string_array(words) -> str:
    return f"array({', '.join(map(literal, words))})"


def let(name: str, value: str, body: str) -> str:
    """Evaluate ``value`` once per row and use it many times in ``body`` (do not nest deeply)."""
    return f"transform(array({value}), {name} -> {body})[0]"


def indexes(n: str) -> str:
    """0 .. n-1; empty for n = 0."""
    return f"if({n} > 0, sequence(0, {n} - 1), CAST(array() AS ARRAY<INT>))"


def blocks(arr: str, size: int = BLOCK) -> str:
    """Cut an array into consecutive arrays of ``size`` elements (the last may be shorter)."""
    n = f"CAST((size({arr}) + {size - 1}) DIV {size} AS INT)"
    return f"transform({indexes(n)}, b -> slice({arr}, b * {size} + 1, {size}))"


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumns({name: F.expr(sql) for name, sql in columns.items()})


def settle(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns whose expressions later filters cannot be pushed through.

    Catalyst pushes a filter below projections by copying the expressions it refers
    to, at every step, whatever they cost; over a chain of array steps the copies
    multiply. The output of a generator is not substituted, so each row passes a
    generator that yields exactly one row.
    """
    fields = ", ".join(f"{literal(n)}, {sql}" for n, sql in columns.items())
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.expr(f"inline(array(named_struct({fields})))"))


def with_scans(df: DataFrame, arrays: dict[str, str], zero: int | str,
               combine: Callable[[str, str], str], kind: str = "INT") -> DataFrame:
    """Add arrays that hold, for each element, the combination of all before it.

    ``combine`` makes SQL of type ``kind`` from (so far, next). Works block by block, so
    that appending copies BLOCK-sized arrays and not the whole array: a text with a
    million matches stays affordable. Null stays null.
    """
    cut, head = {n: f"_cut_{n}" for n in arrays}, {n: f"_head_{n}" for n in arrays}
    df = add_columns(df, {cut[n]: f"if(({a}) IS NULL, NULL, {blocks(a)})"
                          for n, a in arrays.items()})
    df = add_columns(df, {head[n]: (
        f"aggregate({cut[n]}, array({zero}), (acc, b) -> array_append(acc, "
        f"aggregate(b, element_at(acc, -1), (a, x) -> {combine('a', 'x')})))") for n in arrays})
    # Arrays meet by zip_with: an array indexed inside a lambda may be inlined by the
    # optimizer and then be computed again for each element.
    df = add_columns(df, {n: (
        f"flatten(zip_with({cut[n]}, slice({head[n]}, 1, size({cut[n]})), (b, h) -> aggregate(b, "
        f"named_struct('at', h, 'out', CAST(array() AS ARRAY<{kind}>)), "
        f"(s, x) -> named_struct('at', {combine('s.at', 'x')}, "
        f"'out', array_append(s.out, s.at)), s -> s.out)))") for n in arrays})
    return df.drop(*cut.values(), *head.values())


def total(so_far: str, x: str) -> str:
    return f"{so_far} + {x}"


def maximum(so_far: str, x: str) -> str:
    return f"greatest({so_far}, {x})"


def with_ranks(df: DataFrame, ranks: dict[str, tuple[str, str, str]]) -> DataFrame:
    """Add integer arrays: for each query how many keys are less than it.

    An entry is (queries, keys, "<" or "<="), both integer arrays; null where one is null.
    One sort of both together and a running count, so the cost does not multiply.
    """
    steps, counts = {n: f"_steps_{n}" for n in ranks}, {n: f"_counts_{n}" for n in ranks}
    events = {}
    for n, (queries, keys, relation) in ranks.items():
        query, key = (0, 1) if relation == "<" else (1, 0)  # who goes first among equals
        events[steps[n]] = (
            f"sort_array(concat(transform({queries}, (x, i) -> named_struct('at', x, 'turn', {query}, 'i', i, 'one', 0)), "
            f"transform({keys}, x -> named_struct('at', x, 'turn', {key}, 'i', -1, 'one', 1))))")
    df = add_columns(df, events)
    df = with_scans(df, {counts[n]: f"transform({steps[n]}, e -> e.one)" for n in ranks}, 0, total)
    return add_columns(df, {n: (
        f"transform(sort_array(filter(zip_with({steps[n]}, {counts[n]}, (e, c) -> named_struct('i', e.i, 'c', c)), "
        f"x -> x.i >= 0)), x -> x.c)") for n in ranks}).drop(*steps.values(), *counts.values())
