"""Regular expressions with Python's meaning on the JVM, and span extraction.

Java's ``\\d \\w \\s \\b`` differ from Python's on non-ASCII text (combining
marks, superscripts, separators), so the classes are written out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from spanveil.functions.arrays import add_columns, literal, total, with_scans
from spanveil.functions.patterns import Pattern

DIGIT = r"\p{Nd}"
SPACE_BODY = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD_BODY = r"a-zA-Z0-9_\p{L}\p{N}"  # ASCII first: tried in this order
# The complement of SPACE_BODY as ranges, the frequent ones first: several times faster
# than a negated class.
NOT_SPACE_BODY = (r"!-~\xa1-\u167f\x00-\x08\x0e-\x1b\x7f-\x84\x86-\x9f\u1681-\u1fff\u200b-\u2027"
                  r"\u202a-\u202e\u2030-\u205e\u2060-\u2fff\u3001-\x{10ffff}")
SPACE, NOT_SPACE = f"[{SPACE_BODY}]", f"[{NOT_SPACE_BODY}]"
WORD = f"[{WORD_BODY}]"
BOUNDARY = f"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"
_OUTSIDE = {"d": DIGIT, "s": SPACE, "S": NOT_SPACE, "w": WORD, "b": BOUNDARY}
_INSIDE = {"d": DIGIT, "s": SPACE_BODY, "w": WORD_BODY}

MARK = "\u0001"
MARK_STAND_IN = "\u0003"  # also a control character: in the same regex classes as MARK


def java(pattern: str) -> str:
    """Spell out the character classes of a Python pattern for Java."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            nxt = pattern[i + 1]
            out.append((_INSIDE if inside else _OUTSIDE).get(nxt, ch + nxt))
            i += 2
            continue
        if ch == "[" and not inside:
            inside = True
        elif ch == "]" and inside:
            inside = False
        out.append(ch)
        i += 1
    return "".join(out)


def java_flags(flags: str) -> str:
    """Python flags in Java: Unicode case folding, and only \\n ends a line."""
    extra = ("u" if "i" in flags else "") + ("d" if "m" in flags else "")
    return f"(?{flags}{extra})" if flags else ""


def grouped(p: Pattern) -> str:
    """Java form with group 1 = prefix and group 2 = value."""
    ahead = f"(?={p.first})" if p.first else ""
    return f"{java_flags(p.flags)}{ahead}({java(p.scan or p.prefix)})({java(p.scan_value or p.value)}){java(p.scan_tail or p.tail)}"


def matches(p: Pattern) -> str:
    """Java form for a yes/no test."""
    return f"{java_flags(p.flags)}{java(p.prefix)}(?:{java(p.value)}){java(p.tail)}"


def marked_pieces(text: str, pattern: str, replacement: str) -> str:
    """Split ``text`` at the marks that ``replacement`` puts around each match.

    Pieces at odd positions are matches.
    """
    clean = f"translate({text}, {literal(MARK)}, {literal(MARK_STAND_IN)})"
    return (f"split(regexp_replace({clean}, {literal(pattern)}, {literal(replacement)}), "
            f"{literal(MARK)}, -1)")


def _odd_pieces(pieces: str, starts: str) -> str:
    return (f"filter(zip_with({pieces}, {starts}, (t, at) -> named_struct('start', at, "
            f"'end', at + length(t), 'text', t)), (s, i) -> i % 2 = 1)")


def with_found(df: DataFrame, text: str, wanted: dict[str, tuple[Pattern, str]]) -> DataFrame:
    """Add one column per entry with all matches in column ``text``, left to right.

    An entry is (pattern, SQL condition). The columns are ARRAY<STRUCT<start, end,
    text>> (code points, half-open), or null where the condition is not true.
    """
    pieces = {n: f"_pieces_{n}" for n in wanted}
    starts = {n: f"_starts_{n}" for n in wanted}
    df = add_columns(df, {
        "_has_mark": f"contains({text}, {literal(MARK)})",
        **{pieces[n]: f"if({condition}, "
                      f"{marked_pieces(text, grouped(p), f'$1{MARK}$2{MARK}')}, NULL)"
           for n, (p, condition) in wanted.items()}})
    df = with_scans(df, {starts[n]: f"transform({pieces[n]}, t -> length(t))" for n in wanted},
                    0, total)
    # Values are cut from the text itself where the mark character occurs in it.
    df = add_columns(df, {n: (
        f"if(NOT _has_mark, {_odd_pieces(pieces[n], starts[n])}, transform("
        f"{_odd_pieces(pieces[n], starts[n])}, s -> named_struct('start', s.start, 'end', s.end, "
        f"'text', substring({text}, s.start + 1, s.end - s.start))))") for n in wanted})
    return df.drop("_has_mark", *pieces.values(), *starts.values())


def with_found_everywhere(df: DataFrame, text: str, bodies: dict[str, str],
                          condition: str) -> DataFrame:
    """Add one column per entry with the matches at every start, also inside other matches.

    A lookahead copies the match in front of its place, so matches may overlap; a
    body must be able to match in at most one way per start.
    """
    pieces = {n: f"_pieces_{n}" for n in bodies}
    starts = {n: f"_starts_{n}" for n in bodies}

    def pattern(body: str) -> str:
        return f"(?iu)(?<!{WORD})(?=({body})(?!{WORD}))"

    df = add_columns(df, {
        pieces[n]: f"if({condition}, {marked_pieces(text, pattern(b), f'{MARK}$1{MARK}')}, NULL)"
        for n, b in bodies.items()})
    df = with_scans(df, {starts[n]: f"transform({pieces[n]}, (t, i) -> if(i % 2 = 1, 0, length(t)))"
                         for n in bodies}, 0, total)
    return add_columns(df, {n: _odd_pieces(pieces[n], starts[n]) for n in bodies}
                       ).drop(*pieces.values(), *starts.values())
