"""Scalar text functions: SQL text in, SQL text out."""

from __future__ import annotations

from spanveil.functions import dictionaries as D
from spanveil.functions.arrays import is_in, literal
from spanveil.functions.regex import BOUNDARY, DIGIT, NOT_SPACE, SPACE

# Characters that case folding turns into ASCII but lower() does not.
FOLDED = {"ß": "ss", "ẞ": "ss", "ſ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl",
          "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}


def casefold(c: str) -> str:
    """Lower case, plus the foldings that can end in ASCII (all dictionaries are ASCII)."""
    folded = f"lower({c})"
    for char, ascii_form in FOLDED.items():
        folded = f"replace({folded}, {literal(char)}, {literal(ascii_form)})"
    odd = literal("[" + "".join(FOLDED) + "]")
    return f"if(rlike({c}, {odd}), {folded}, lower({c}))"


def strip(c: str) -> str:
    """Remove white space at both ends. Each run of it is tried once, so long ones inside cost little."""
    return f"regexp_replace({c}, {literal(f'^{SPACE}+|(?<!{SPACE}){SPACE}+$')}, '')"


def strip_chars(c: str, chars: str) -> str:
    """Remove the given characters at both ends."""
    return f"btrim({c}, {literal(chars)})"


def normalize(c: str) -> str:
    """Strip, collapse white space to one blank, fold case."""
    return casefold(f"regexp_replace({strip(c)}, {literal(SPACE + '+')}, ' ')")


def tokens(c: str) -> str:
    """White-space tokens; empty for a blank text."""
    return f"filter(split({c}, {literal(SPACE + '+')}, -1), t -> t <> '')"


def count_tokens(c: str) -> str:
    return f"regexp_count({c}, {literal(NOT_SPACE + '+')})"


def digits_only(c: str) -> str:
    return f"regexp_replace({c}, {literal(f'[^{DIGIT}]')}, '')"


def is_upper(c: str) -> str:
    """At least one cased character, and none in lower case."""
    return f"({c} = upper({c}) AND {c} <> lower({c}))"


def starts_upper(token: str) -> str:
    return is_upper(f"left({token}, 1)")


def has_letter(token: str) -> str:
    return f"rlike({token}, {literal(chr(92) + 'p{L}')})"


def drop_article(normalized: str) -> str:
    """Remove a leading the/our/this from a normalised value."""
    return f"regexp_replace({normalized}, {literal(f'^(?:the|our|this){SPACE}+')}, '')"


def is_legal_reference(normalized: str) -> str:
    """The value is one of the legal-reference words."""
    return is_in(normalized, D.LEGAL_REFERENCE_WORDS)


def starts_legal_reference(normalized: str) -> str:
    words = "|".join(D.LEGAL_REFERENCE_WORDS)
    return f"rlike({normalized}, {literal(f'^(?:{words}){BOUNDARY}')})"


def valid_ipv4(c: str) -> str:
    """Four ASCII octets 0-255 without leading zeros."""
    octet = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return f"rlike({c}, {literal('^(?:' + octet + chr(92) + '.){3}' + octet + '$')})"


def ascii_digits(digits: str) -> str:
    """Map decimal digits of the common scripts to 0-9."""
    zeros = "٠۰०০੦૦୦௦౦೦൦๐０"
    source = "".join(chr(ord(z) + i) for z in zeros for i in range(10))
    return f"translate({digits}, {literal(source)}, {literal('0123456789' * len(zeros))})"


def valid_card(c: str) -> str:
    """13 to 19 digits that pass the Luhn check."""
    digits = digits_only(c)
    return (f"(length({digits}) BETWEEN 13 AND 19 "
            f"AND coalesce(luhn_check({ascii_digits(digits)}), false))")


def overlap(a: str, b: str) -> str:
    """Two half-open intervals share a character."""
    return f"({a}.start < {b}.end AND {b}.start < {a}.end)"


def is_yes(c: str) -> str:
    """Truthy review verdict."""
    return is_in(casefold(strip(c)), D.YES_VERDICTS)


def to_sorted_json(pairs: str) -> str:
    """ARRAY<STRUCT<key, value>> as a JSON object with sorted keys."""
    return f"to_json(map_from_entries(sort_array({pairs})))"
