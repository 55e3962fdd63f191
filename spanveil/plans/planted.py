"""Texts with known spans, derived from the customer table.

Every expression is plain SQL over k (= c_custkey) that Spark and DuckDB read alike,
so that expected spans follow from string lengths and need no pattern.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanveil.functions import dictionaries as D

K = "c_custkey"


def _pad(expr: str, n: int) -> str:
    return f"lpad(CAST({expr} AS STRING), {n}, '0')"


def _s(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


CARD_NO = f"CAST(floor({K} / 12.0) AS INT) % 4"

# kind (NULL = nothing to find), prefix, value, suffix; chosen by k % 12.
TEMPLATES: list[tuple[str | None, str, str, str]] = [
    ("EMAIL", "'Write to '", f"'user' || {_s(K)} || '@mail' || {_s(f'{K} % 7')} || '.example.com'",
     "' soon.'"),
    ("PHONE", "'Call '", f"'+91 9' || {_pad(f'{K} % 10000', 4)} || ' ' || {_pad(f'{K} * 7 % 100000', 5)}",
     "' today.'"),
    ("IP_ADDRESS", "'Host '", f"'10.' || {_s(f'{K} % 256')} || '.' || {_s(f'{K} * 7 % 256')} || '.' "
     f"|| {_s(f'1 + {K} % 250')}", "' is up.'"),
    (None, "'Host '", f"'10.300.1.' || {_s(f'{K} % 250')}", "' is wrong.'"),
    ("SSN", "'Number '", f"{_pad(f'100 + {K} % 800', 3)} || '-' || {_pad(f'10 + {K} % 80', 2)} || '-' "
     f"|| {_pad(f'{K} % 10000', 4)}", "' on file.'"),
    ("CREDIT_CARD", "'Paid by '", f"CASE {CARD_NO} WHEN 0 THEN '4012 8888 8888 1881' "
     "WHEN 1 THEN '4111111111111111' WHEN 2 THEN '5500005555555559' ELSE '4111-1111-1111-1111' END",
     "' twice.'"),
    (None, "'Paid by '", "'4111111111111112'", "' once.'"),
    ("DOB", "'Date of Birth: '", f"{_pad(f'1 + {K} % 28', 2)} || '/' || {_pad(f'1 + {K} % 12', 2)} || "
     f"'/19' || {_pad(f'40 + {K} % 60', 2)}", "' noted.'"),
    ("ORG", "'signed by Our Company '", f"'Acme' || {_s(K)} || ' Steel Private Limited'", "' today.'"),
    (None, "'filed with '", "'BSE Limited'", "' today.'"),
    ("ADDRESS", "'Registered Office: '", f"{_s(K)} || ' Hill Road, Pune, India'", "'; end'"),
    ("ADDRESS", "'Taluka: '", f"'Haveli ' || {_s(K)}", "'; end'"),
]


def _choose(column: int) -> str:
    cases = " ".join(
        f"WHEN {i} THEN " + (row[column] if column else
                             (f"'{row[0]}'" if row[0] else "CAST(NULL AS STRING)"))
        for i, row in enumerate(TEMPLATES))
    return f"CASE {K} % {len(TEMPLATES)} {cases} END"


NOTES_SQL = (
    f"SELECT {K} AS note_id, {_choose(0)} AS kind, {_choose(1)} AS prefix, "
    f"{_choose(2)} AS value, {_choose(3)} AS suffix FROM customer")
NOTES_CTE = f"""notes AS (SELECT note_id, kind, prefix, value, suffix,
    prefix || value || suffix AS text, length(prefix) AS s, length(prefix) + length(value) AS e
    FROM ({NOTES_SQL}))"""


def notes(customer: DataFrame) -> DataFrame:
    """note_id, kind, prefix, value, suffix, text."""
    return customer.selectExpr(
        f"{K} AS note_id", f"{_choose(0)} AS kind", f"{_choose(1)} AS prefix",
        f"{_choose(2)} AS value", f"{_choose(3)} AS suffix").withColumn(
        "text", F.concat("prefix", "value", "suffix"))


class Case:
    """A text with one external span, and what the gates say to it (and to pattern spans)."""

    def __init__(self, source: str, label: str, score: float, prefix: str, value: str, suffix: str,
                 fate: str | None, entity_type: str | None = None,
                 pattern: tuple[str, str, int, str] | None = None):
        self.source, self.label, self.score = source, label, score
        self.prefix, self.value, self.suffix = prefix, value, suffix
        self.fate, self.entity_type = fate, entity_type
        # A further span by pattern: (type, value SQL, offset from the end of the prefix, fate)
        self.pattern = pattern


N = _s(K)
P, S = "presidio", "spacy"
CASES = [
    Case(P, "PERSON", .99, "'Met '", f"'Rashi Patil' || {N}", "' there'", "kept", "PERSON"),
    Case(P, "PERSON", .99, "'Gap'", "'   '", f"'at ' || {N}", "empty", "PERSON"),
    Case(P, "ORGANIZATION", .99, "'The '", f"'Offer Price Group' || {N}", "' met'",
         "protected_span_skipped", "ORG"),
    Case(P, "PHONE_NUMBER", .99, "'Ring '", f"'987-' || {_s(f'{K} % 1000')}", "' now'",
         "short_numeric_fragment", "PHONE"),
    Case(P, "PERSON", .99, "'Lot '", f"{N} || '-77'", "' sold'", "numeric_fragment", "PERSON"),
    Case(P, "PERSON", .99, "'By '", "'ABC'", f"' no ' || {N}", "short_abbreviation", "PERSON"),
    Case(P, "EMAIL_ADDRESS", .99, "'Tag x'", "'rbi'", f"{N}", "public_organization", "EMAIL"),
    Case(P, "EMAIL_ADDRESS", .99, "'Tag x'", "'cin'", f"{N}", "protected_term", "EMAIL"),
    Case(P, "PERSON", .99, "'See '", "'Table'", f"' ' || {N}", "blacklist", "PERSON"),
    Case(P, "ORGANIZATION", .99, "'See '", f"'Section ' || {N}", "' above'", "blacklist", "ORG"),
    Case(P, "PERSON", .99, "'In '", f"'ANNUAL REPORT ' || {N}", "' text'", "blacklist", "PERSON"),
    Case(P, "PERSON", .91, "'Met '", f"'Rashi Patil' || {N}", "' there'", "confidence", "PERSON"),
    Case(S, "PERSON", .99, "'Met '", f"'Rashi Patil' || {N}", "' there'", "confidence", "PERSON"),
    Case(P, "PERSON", .99, "'To '", "'Directorate'", f"' ' || {N}", "person_role_word", "PERSON"),
    Case(P, "PERSON", .99, "'On '", f"'Hill Road ' || {N}", "' left'", "person_address_fragment",
         "PERSON"),
    Case(P, "PERSON", .95, "'Met '", "'Rashi'", f"' at ' || {N}", "person_single_word", "PERSON"),
    Case(P, "PERSON", .99, "'met '", "'rashi patil'", f"' at ' || {N}", "person_not_titlecase",
         "PERSON"),
    Case(P, "ORGANIZATION", .99, "'by '", f"'The Acme' || {N} || ' Trading Limited'", "' here'",
         "org_prose_span", "ORG", ("ORG", f"'Acme' || {N} || ' Trading Limited'", 4, "kept")),
    Case(P, "ORGANIZATION", .99, "'by '", f"'Acme Works ' || {N}", "' here'", "org_weak", "ORG"),
    Case(P, "ORGANIZATION", .99, "'by '", "'acme 1Works'", f"' Limited no ' || {N}",
         "org_not_titlecase", "ORG", ("ORG", "'Works Limited'", 6, "kept")),
    Case(P, "ORGANIZATION", .99, "'by '", f"'Acme' || {N} || ' Works'", "' Limited here'",
         "overlap", "ORG", ("ORG", f"'Acme' || {N} || ' Works Limited'", 0, "kept")),
    Case(P, "ORGANIZATION", .99, "'by '", f"'Acme' || {N} || ' Works Limited'", "' here'",
         "duplicate", "ORG", ("ORG", f"'Acme' || {N} || ' Works Limited'", 0, "kept")),
    Case(P, "LOCATION", .99, "'seen in '", f"'Navi Town ' || {N}", "' once'", None),
    Case(P, "LOCATION", .99, "'address '", f"'Navi Town ' || {N}", "' once'", "kept", "ADDRESS"),
    Case(P, "DATE_TIME", .99, "'on '", "'Monday'", f"' ' || {N}", None),
    Case(P, "PERSON", .89, "'Met '", f"'Rashi Patil' || {N}", "' there'", None),
    Case(S, "GPE", .99, "'in '", f"'Navi Town ' || {N}", "' once'", None),
    Case(P, "PERSON", .99, "'Host 10.300.1.2 of '", f"'Rashi Patil' || {N}", "' there'", "kept",
         "PERSON", ("IP_ADDRESS", "'10.300.1.2'", -14, "invalid_ip")),
    Case(P, "PERSON", .99, "'Card 4111111111111112 of '", f"'Rashi Patil' || {N}", "' there'",
         "kept", "PERSON", ("CREDIT_CARD", "'4111111111111112'", -20, "invalid_card")),
]


def _case(pick) -> str:
    return (f"CASE {K} % {len(CASES)} "
            + " ".join(f"WHEN {i} THEN {pick(c)}" for i, c in enumerate(CASES)) + " END")


CASE_COLUMNS = {
    "note_id": K, "prefix": _case(lambda c: c.prefix), "value": _case(lambda c: c.value),
    "suffix": _case(lambda c: c.suffix), "source": _case(lambda c: f"'{c.source}'"),
    "label": _case(lambda c: f"'{c.label}'"), "score": _case(lambda c: f"CAST({c.score} AS DOUBLE)")}


def gate_cases(customer: DataFrame) -> DataFrame:
    """note_id, text, and the external span: source, start, end, label, score."""
    df = customer.selectExpr(*[f"{sql} AS {n}" for n, sql in CASE_COLUMNS.items()])
    return df.selectExpr(
        "note_id", "prefix || value || suffix AS text", "source", "label", "score",
        "CAST(length(prefix) AS INT) AS start", "CAST(length(prefix) + length(value) AS INT) AS end")


def _fate_rows() -> str:
    """Expected candidates: note_id, entity_type, start, end, source, fate."""
    parts = []
    for i, c in enumerate(CASES):
        where = f"FROM customer WHERE {K} % {len(CASES)} = {i}"
        if c.fate:
            parts.append(
                f"SELECT {K} AS note_id, '{c.entity_type}' AS entity_type, "
                f"length({c.prefix}) AS s, length({c.prefix}) + length({c.value}) AS e, "
                f"'{c.source}' AS source, '{c.fate}' AS fate {where}")
        if c.pattern:
            kind, value, offset, fate = c.pattern
            parts.append(
                f"SELECT {K} AS note_id, '{kind}' AS entity_type, length({c.prefix}) + ({offset}) AS s, "
                f"length({c.prefix}) + ({offset}) + length({value}) AS e, 'regex' AS source, "
                f"'{fate}' AS fate {where}")
    return " UNION ALL ".join(parts)


FATES_CTE = f"fates AS ({_fate_rows()})"


def dictionary_entries() -> list[tuple[str, str]]:
    """Every dictionary entry of the gates, with the reason that it is turned down for."""
    protected = D.PROTECTED_TERMS + D.LEGAL_REFERENCE_WORDS
    reasons = {**dict.fromkeys(D.GENERIC_TERMS, "blacklist"), **dict.fromkeys(protected, "protected_term"),
               **dict.fromkeys(D.PUBLIC_ORGANIZATIONS, "public_organization")}
    return sorted(reasons.items())
