"""Secret scans: fixed patterns, and probabilistic automata inferred from the credentials they find.

Inference (per kind of credential): a prefix tree of the labelled strings, over classes of
characters, counts how often each state is passed and ends. States are merged from the root on when
a Hoeffding test finds their ending and their outgoing frequencies compatible, with all that follows
from them. The result is a small probabilistic automaton of the format.

Scoring: every token of 16 or more credential characters, with a letter and a digit, outside the
spans of the patterns, gets its best mean log-likelihood per character over the kinds. It is a
secret when that is no less than the credentials' own lower quantile, less a margin. What the patterns
find stays, and is scored by the same automata, so that all candidates have a format likelihood.

The labelled strings are a bounded sample: per kind the ``SAMPLE`` distinct ones with the smallest
hash, of at most ``LONGEST`` characters, from all documents. Everything else covers all rows. Without
credentials nothing is added.

A null text is empty. Offsets are code points, ends exclusive. Repeated rows are scanned each.
Columns other than the text are kept.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spanveil.llm.common import free_name
from spanveil.llm.words import slices, text_bytes

#: Fixed patterns: kind, expression, group that is measured, least length of it.
KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, TOKEN_LEAST = 6, 20, 24, 16
HINTS = ("passw", "secret", "token", "api")
SAMPLE, LONGEST, ALPHA, QUANTILE, MARGIN = 400, 1024, 0.05, 0.02, 0.15
SLICE = 1 << 20  # bytes of text that are scanned at once


def _class_table(*ranges: str) -> np.ndarray:
    table = np.zeros(256, bool)
    for r in ranges:
        table[ord(r[0]):ord(r[-1]) + 1] = True
    return table


HEX = _class_table("09", "af")
TOKEN = _class_table("09", "az", "AZ", "+", "/", "_", "=", "-")
DIGIT, LETTER = _class_table("09"), _class_table("az", "AZ")


def _runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of at least that many bytes within rows."""
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    opens, closes = inside.copy(), inside.copy()
    if len(inside):
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes[:-1] &= ~inside[1:] | edge[1:-1]
    start, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    long = end - start >= least
    return start[long], end[long]


def scan(column: pa.Array) -> Iterator[tuple[list[tuple[str, int, int, str]], list[tuple[int, int, str]]]]:
    """Per text: spans of the patterns (kind, start, end, credential), and other tokens (start, end, token)."""
    data, offsets = text_bytes(column)
    hex_start, hex_end = _runs(HEX[data], offsets, HEX_LEAST)
    start, end = _runs(TOKEN[data], offsets, TOKEN_LEAST)
    digits, letters = (np.concatenate([[0], np.cumsum(t[data], dtype=np.int64)]) for t in (DIGIT, LETTER))
    mixed = (digits[end] > digits[start]) & (letters[end] > letters[start])
    start, end = start[mixed], end[mixed]
    hex_at, token_at = np.searchsorted(hex_start, offsets), np.searchsorted(start, offsets)
    for r, value in enumerate(column.to_pylist()):
        value = value or ""
        found = []
        if ("=" in value or ":" in value) and any(h in (low := value.lower()) for h in HINTS):
            del low
            found += [("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(value) if len(m[2]) >= ASSIGN_LEAST]
        if "AKIA" in value:
            found += [("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(value) if len(m[0]) >= ACCESS_LEAST]
        places = [(hex_start[i], hex_end[i]) for i in range(hex_at[r], hex_at[r + 1])]
        others = [(start[i], end[i]) for i in range(token_at[r], token_at[r + 1])]
        if places or others:
            ascii_only = len(value) == offsets[r + 1] - offsets[r]
            ahead = None if ascii_only else np.concatenate(  # code points before each byte
                [[0], np.cumsum((data[offsets[r]:offsets[r + 1]] & 0xC0) != 0x80)])

            def at(a: int, b: int) -> tuple[int, int]:
                a, b = int(a - offsets[r]), int(b - offsets[r])
                return (a, b) if ahead is None else (int(ahead[a]), int(ahead[b]))

            found += [("hex", *(s := at(a, b)), value[s[0]:s[1]]) for a, b in places]
            found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
            spans = [(*(s := at(a, b)), value[s[0]:s[1]]) for a, b in others]
            # the spans that begin before a token's end are the first ones; do they reach into it?
            begins, reach = [f[1] for f in found], list(accumulate((f[2] for f in found), max))
            spans = [s for s in spans if not (k := bisect_left(begins, s[1])) or reach[k - 1] <= s[0]]
        else:
            found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
            spans = []
        yield found, spans


def symbols(value: str) -> str:
    """Characters by class: digit, hex and other letters of either case; signs as they are."""
    return "".join(
        "d" if c.isdigit() else "h" if "a" <= c <= "f" else "l" if c.islower() else
        "H" if "A" <= c <= "F" else "L" if c.isupper() else c for c in value)


class Automaton:
    """A probabilistic automaton, inferred by merging compatible states of a prefix tree."""

    def __init__(self, strings: list[str], alpha: float = ALPHA):
        self.next: list[dict[str, int]] = [{}]
        self.passed: list[dict[str, int]] = [{}]
        self.ended, self.total = [0], [0]
        for s in sorted(strings):
            state = 0
            self.total[0] += 1
            for c in s:
                if c not in self.next[state]:
                    self.next[state][c] = len(self.next)
                    self.next.append({})
                    self.passed.append({})
                    self.ended.append(0)
                    self.total.append(0)
                self.passed[state][c] = self.passed[state].get(c, 0) + 1
                state = self.next[state][c]
                self.total[state] += 1
            self.ended[state] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._infer()
        scores = sorted(self.score(s) for s in strings)
        self.least = scores[int(QUANTILE * len(scores))] - MARGIN if scores else math.inf

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > self.bound * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, p: int, q: int) -> bool:
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            n, m = self.total[p], self.total[q]
            if self._differ(self.ended[p], n, self.ended[q], m):
                return False
            for c in self.passed[p].keys() | self.passed[q].keys():
                if self._differ(self.passed[p].get(c, 0), n, self.passed[q].get(c, 0), m):
                    return False
                if c in self.next[p] and c in self.next[q]:
                    todo.append((self.next[p][c], self.next[q][c]))
        return True

    def _merge(self, p: int, q: int, parent: int, symbol: str) -> None:
        """Lead the parent's arc to p, and fold the tree below q into p."""
        self.next[parent][symbol] = p
        todo = [(p, q)]
        while todo:
            p, q = todo.pop()
            self.ended[p] += self.ended[q]
            self.total[p] += self.total[q]
            for c, n in self.passed[q].items():
                self.passed[p][c] = self.passed[p].get(c, 0) + n
                if c in self.next[p]:
                    todo.append((self.next[p][c], self.next[q][c]))
                else:
                    self.next[p][c] = self.next[q][c]

    def _infer(self) -> None:
        settled = [0]
        while True:
            border = sorted((self.next[p][c], p, c) for p in settled for c in self.next[p] if self.next[p][c] not in settled)
            if not border:
                break
            q, parent, symbol = border[0]
            for p in settled:
                if self._compatible(p, q):
                    self._merge(p, q, parent, symbol)
                    break
            else:
                settled.append(q)

    def score(self, string: str) -> float:
        """Mean log-likelihood per character, the end included; minus infinity if impossible."""
        state, total = 0, 0.0
        for c in string:
            n = self.passed[state].get(c, 0)
            if not n:
                return -math.inf
            total += math.log(n / self.total[state])
            state = self.next[state][c]
        if not self.ended[state]:
            return -math.inf
        return (total + math.log(self.ended[state] / self.total[state])) / (len(string) + 1)


def labelled(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> list[tuple[str, str]]:
    """Kind and string of at most ``sample`` distinct credentials per kind."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            found = {(f[0], f[3]) for spans, _ in scan(batch.column("text")) for f in spans}
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()),
                                              pa.array([f[1] for f in found], pa.string())], ["kind", "value"])

    rows = docs.select(F.col(f"`{text}`").cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(
        run, "kind string, value string").where(F.length("value") <= LONGEST).distinct()
    # the smallest hashes of each task first, so that no kind meets whole in one task
    order, top = [F.xxhash64("value"), "value"], rows.withColumn("part", F.spark_partition_id())
    for keys in (["kind", "part"], ["kind"]):
        top = top.withColumn("nr", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nr") <= sample)
    return sorted((r["kind"], r["value"]) for r in top.select("kind", "value").collect())


def infer(credentials: list[tuple[str, str]]) -> dict[str, Automaton]:
    """An automaton per kind."""
    kinds: dict[str, list[str]] = {}
    for kind, value in credentials:
        kinds.setdefault(kind, []).append(symbols(value))
    return {kind: Automaton(strings) for kind, strings in sorted(kinds.items())}


def likelihood(token: str, automata: dict[str, Automaton]) -> float:
    """The best mean log-likelihood per character over the kinds; minus infinity without any."""
    string = symbols(token)
    return max((a.score(string) for a in automata.values()), default=-math.inf)


def is_secret(token: str, automata: dict[str, Automaton]) -> bool:
    string = symbols(token)
    return any(a.score(string) >= a.least for a in automata.values())


def _spans(column: pa.Array, automata: dict[str, Automaton]) -> Iterator[list[tuple[str, int, int, str]]]:
    for found, others in scan(column):
        spans = found + [("model", a, b, t) for a, b, t in others if is_secret(t, automata)]
        spans.sort(key=lambda s: (s[1], KINDS.index(s[0])))
        yield spans


def find_secrets(docs: DataFrame, automata: dict[str, Automaton], text: str = "text", into: str = "secrets",
                 scores: str | None = None) -> DataFrame:
    """The rows with an array of spans (kind, start, end) added, by start and kind.

    ``scores``: a further column for the likelihood of each span, null for one that no automaton accepts.
    """
    docs = docs.drop(into, *([scores] if scores else []))
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text]).alias("_row")
                        if len(docs.columns) > 1 else F.lit(None).cast("int").alias("_row"),
                        F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in slices(batches, "text", SLICE):
            found = list(_spans(batch.column("text"), automata))
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b, _ in s] for s in found]
            told = [[v if math.isfinite(v := likelihood(t, automata)) else None for *_, t in s] if scores else [] for s in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind), pa.array(told, pa.list_(pa.float64()))],
                                             ["_row", "text", "spans", "scores"])

    out = given.mapInArrow(run, f"_row {given.schema['_row'].dataType.simpleString()}, text string, "
                                "spans array<struct<kind: string, start: int, end: int>>, scores array<double>")
    return out.select(*[F.col("text").alias(c) if c == text else F.col("_row").getField(c).alias(c) for c in docs.columns],
                      F.col("spans").alias(into), *([F.col("scores").alias(scores)] if scores else []))


def mask_secrets(docs: DataFrame, automata: dict[str, Automaton], text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows with every secret of the text replaced; overlapping spans are one. Null stays null."""
    spans, out = free_name(docs, "_secrets"), free_name(docs, "_masked")
    found = find_secrets(docs, automata, text, spans)
    merged = F.expr(
        f"aggregate({spans}, CAST(array() AS ARRAY<STRUCT<s: INT, e: INT>>), (a, x) -> if(size(a) > 0 AND "
        "x.start < element_at(a, -1).e, concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, "
        "'e', greatest(element_at(a, -1).e, x.end)))), array_append(a, named_struct('s', x.start, 'e', x.end))))")
    done = found.withColumn(spans, merged).withColumn(out, F.expr(
        f"aggregate({spans}, named_struct('at', 0, 'out', ''), (a, x) -> named_struct('at', x.e, 'out', "
        f"concat(a.out, substring(`{text}`, a.at + 1, x.s - a.at), '{mask}')), "
        f"a -> concat(a.out, substring(`{text}`, a.at + 1, length(`{text}`))))"))
    return done.select(*[F.col(out).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
