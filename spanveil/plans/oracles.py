"""The same results in DuckDB SQL, by other means: RE2 patterns, arithmetic, plain joins."""

from __future__ import annotations

import re

from spanveil.functions import pseudonyms as N
from spanveil.operators.protected import PHRASES as PROTECTED_PHRASES
from spanveil.plans.planted import CASES, FATES_CTE, K, NOTES_CTE, dictionary_entries

TYPES = ("PERSON", "EMAIL", "PHONE", "ADDRESS", "ORG", "SSN", "CREDIT_CARD", "IP_ADDRESS", "DOB")

# RE2 forms for the driver's tables (RE2 has no lookaround, and its \b is ASCII).
RE_EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"
RE_IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
RE_DIGITS = r"\d+"
OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _luhn(d: str) -> str:
    """Luhn check of a string of digits by list arithmetic."""
    x = f"CAST(substr({d}, length({d}) - i, 1) AS INT)"
    return (f"list_sum(list_transform(range(0, length({d})), lambda i: CASE WHEN i % 2 = 0 THEN {x} "
            f"WHEN {x} > 4 THEN 2 * {x} - 9 ELSE 2 * {x} END)) % 10 = 0")


VALID = {
    "EMAIL": "true", "IP_ADDRESS": f"regexp_full_match(v, '({OCTET}\\.){{3}}{OCTET}')",
    "CREDIT_CARD": f"length(v) BETWEEN 13 AND 19 AND {_luhn('v')}",
    "PHONE": "length(v) = 10 AND v[1] >= '6'"}
PATTERN = {"EMAIL": RE_EMAIL, "IP_ADDRESS": RE_IP, "CREDIT_CARD": RE_DIGITS, "PHONE": RE_DIGITS}


def _hits(entity_type: str) -> str:
    """doc_id, span_start, span_end, text, entity_type of valid matches in documents."""
    return f"""
    SELECT doc_id, s AS span_start, s + length(v) AS span_end, v AS text, '{entity_type}' AS entity_type
    FROM (SELECT doc_id, CAST(list_sum(list_transform(p[1:i - 1], lambda x: length(x))) AS BIGINT) AS s,
                 p[i] AS v
          FROM (SELECT doc_id, p, unnest(range(2, len(p) + 1, 2)) AS i
                FROM (SELECT doc_id, string_split(regexp_replace(text, '{PATTERN[entity_type]}',
                             chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS p FROM documents)))
    WHERE {VALID[entity_type]}"""


# Page sources with mail addresses, addresses of machines and card numbers masked, and their planted end.
_MAILS_MASKED = f"regexp_replace(html, '{RE_EMAIL}', '<EMAIL>', 'g')"
_MACHINES_MASKED = f"regexp_replace({_MAILS_MASKED}, '\\b{OCTET}(\\.{OCTET}){{3}}\\b', '<IP_ADDRESS>', 'g')"
MASKED_PAGE = (
    f"array_to_string(list_transform(string_split(regexp_replace({_MACHINES_MASKED}, '{RE_DIGITS}', "
    f"chr(1) || '\\0' || chr(1), 'g'), chr(1)), lambda v, nth: CASE WHEN nth % 2 = 0 AND {VALID['CREDIT_CARD']} "
    f"THEN '<CREDIT_CARD>' ELSE v END), '')")
PLANTED_TAIL = ("'<p title=\"4111111111111111\">Paid by <CREDIT_CARD><b></b> twice</p>"
                "<p>4111 1111</p><p>1111 1111</p>'")

ALL_HITS = " UNION ALL ".join(_hits(t) for t in PATTERN)


def _planted(where: str) -> str:
    return (f"WITH {NOTES_CTE} SELECT note_id, s AS span_start, e AS span_end, value AS text, "
            f"kind AS entity_type FROM notes WHERE {where}")


def _number(h: str, i: int) -> str:
    return f"CAST('0x' || substr({h}, {1 + 8 * i}, 7) AS BIGINT)"


def _pick(h: str, i: int, words) -> str:
    items = ", ".join(f"'{w}'" for w in words)
    return f"([{items}])[1 + {_number(h, i)} % {len(words)}]"


def _fake(kind: str, value: str, seed: int = N.SEED) -> str:
    """The fakes by type, from the same hash."""
    h = f"md5('{seed}|' || {kind} || '|' || {value})"
    n = lambda i: _number(h, i)
    person = f"{_pick(h, 0, N.FIRST_NAMES)} || ' ' || {_pick(h, 1, N.LAST_NAMES)}"
    body = f"'4' || lpad(CAST({n(0)} % 10000000 AS STRING), 7, '0') || lpad(CAST({n(1)} % 10000000 AS STRING), 7, '0')"
    check = f"(list_filter(range(0, 10), lambda c: {_luhn(f'({body} || CAST(c AS STRING))')})[1])"
    return f"""CASE {kind}
    WHEN 'PERSON' THEN {person}
    WHEN 'ORG' THEN {person} || ' Technologies Private Limited'
    WHEN 'EMAIL' THEN lower({_pick(h, 0, N.FIRST_NAMES)} || '.' || {_pick(h, 1, N.LAST_NAMES)})
        || lpad(CAST({n(2)} % 10000 AS STRING), 4, '0') || '@' || {_pick(h, 3, N.MAIL_DOMAINS)}
    WHEN 'PHONE' THEN '+91 ' || CAST(6 + {n(0)} % 4 AS STRING)
        || lpad(CAST({n(1)} % 100000 AS STRING), 5, '0') || lpad(CAST({n(2)} % 10000 AS STRING), 4, '0')
    WHEN 'ADDRESS' THEN CAST(1 + {n(0)} % 999 AS STRING) || ' ' || {_pick(h, 1, N.STREETS)} || ', '
        || {_pick(h, 2, N.PLACES)} || ', ' || CAST(100000 + {n(3)} % 900000 AS STRING) || ', India'
    WHEN 'DOB' THEN strftime(DATE '{N.BIRTH_FIRST}' + CAST({n(0)} % {N.BIRTH_DAYS} AS INT), '%d/%m/%Y')
    WHEN 'IP_ADDRESS' THEN CAST(1 + {n(0)} % 223 AS STRING) || '.' || CAST({n(1)} % 256 AS STRING)
        || '.' || CAST({n(2)} % 256 AS STRING) || '.' || CAST(1 + {n(3)} % 254 AS STRING)
    WHEN 'CREDIT_CARD' THEN {body} || CAST({check} AS STRING)
    WHEN 'SSN' THEN lpad(CAST(1 + {n(0)} % 999 AS STRING), 3, '0') || '-'
        || lpad(CAST(1 + {n(1)} % 99 AS STRING), 2, '0') || '-'
        || lpad(CAST(1 + {n(2)} % 9999 AS STRING), 4, '0')
    ELSE '<REDACTED>' END"""


MAPPING_CTE = f"""{NOTES_CTE},
    firsts AS (SELECT value AS original, min_by(kind, note_id) AS entity_type FROM notes
               WHERE kind IS NOT NULL GROUP BY value),
    old AS (SELECT DISTINCT value AS original, kind AS entity_type, 'old-' || upper(value) AS replacement
            FROM notes WHERE kind IS NOT NULL AND note_id % 5 = 0
            UNION ALL SELECT 'never seen', 'PERSON', 'still here'),
    mapping AS (SELECT * FROM old UNION ALL
                SELECT original, entity_type, {_fake('entity_type', 'original')} AS replacement
                FROM firsts WHERE original NOT IN (SELECT original FROM old))"""

PHRASES = """SELECT p_partkey, p_partkey % 6 AS t, length('Lot ' || CAST(p_partkey AS STRING)) AS n FROM part"""

TRUTH_CTE = f"""{NOTES_CTE},
    truth AS (SELECT note_id, s + CASE WHEN note_id % 7 = 2 THEN 1 ELSE 0 END AS s, e,
              CASE WHEN note_id % 11 = 3 THEN 'PERSON' ELSE kind END AS kind
              FROM notes WHERE kind IS NOT NULL AND note_id % 10 <> 1),
    predicted AS (SELECT note_id, s, e, kind FROM notes WHERE kind IS NOT NULL),
    compared AS (SELECT t.note_id IS NOT NULL AS t, p.note_id IS NOT NULL AS p,
                 coalesce(t.kind, p.kind) AS kind FROM truth t FULL JOIN predicted p
                 ON t.note_id = p.note_id AND t.s = p.s AND t.e = p.e AND t.kind = p.kind),
    cells AS (SELECT count(*) FILTER (t AND p) AS tp, count(*) FILTER (NOT t AND p) AS fp,
              count(*) FILTER (t AND NOT p) AS fn FROM compared)"""

LINES_CTE = """lines AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
        CAST(l_partkey % 20 AS BIGINT) AS s, CAST(l_partkey % 20 + 1 + l_suppkey % 9 AS BIGINT) AS e,
        CAST(0.9 AS DOUBLE) + CAST(l_suppkey % 3 AS DOUBLE) / 100 AS score,
        CASE l_partkey % 3 WHEN 0 THEN 'regex' WHEN 1 THEN 'presidio' ELSE 'spacy' END AS source,
        CASE l_partkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS rank FROM lineitem),
    uniques AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY l_orderkey, s, e
        ORDER BY score DESC, rank DESC, l_linenumber, l_partkey, l_suppkey) = 1)"""

CHATS = """SELECT conv_id, turn, text || ' Mail to user' || CAST(conv_id AS STRING)
    || '@mail.example.com now.' AS text FROM conversations"""


def _names_in(case) -> bool:
    """The toy model finds Aaaa Bbbb before a digit; such spans then pass the gates."""
    return "Rashi Patil'" in case.value


def _model_rows() -> str:
    found = [i for i, c in enumerate(CASES) if _names_in(c) and c.value.startswith("'Rashi")]
    parts = [f"SELECT {K} AS note_id, length({CASES[i].prefix}) AS s FROM customer "
             f"WHERE {K} % {len(CASES)} = {i}" for i in found]
    return (f"SELECT note_id, s AS span_start, s + 11 AS span_end, 'Rashi Patil' AS text, "
            f"'PERSON' AS entity_type FROM ({' UNION ALL '.join(parts)})")


COUNTERS = """CASE fate WHEN 'public_organization' THEN ['public_organizations_skipped', 'whitelist_hits']
    WHEN 'protected_term' THEN ['whitelist_hits', 'whitelist'] ELSE [fate] END"""


def oracle_sql() -> dict[str, str]:
    field = "prefix = 'Taluka: '"
    office = "prefix = 'Registered Office: '"
    sql = {
        "email_spans": _hits("EMAIL"), "ip_spans": _hits("IP_ADDRESS"),
        "card_spans": _hits("CREDIT_CARD"),
        "planted_phone": _planted("kind = 'PHONE'"), "planted_ssn": _planted("kind = 'SSN'"),
        "planted_dob": _planted("kind = 'DOB'"), "planted_org": _planted("kind = 'ORG'"),
        "planted_address_office": _planted(office), "planted_address_field": _planted(field),
        "planted_spans": _planted("kind IS NOT NULL"),
        "protected_spans": f"""
            SELECT p_partkey, n + a AS span_start, n + a + b AS span_end FROM (
                SELECT p_partkey, n, CASE t WHEN 0 THEN 4 WHEN 1 THEN 4 WHEN 2 THEN 5 WHEN 4 THEN 1 END AS a,
                CASE t WHEN 0 THEN 11 WHEN 1 THEN 39 WHEN 2 THEN 25 WHEN 4 THEN 40 END AS b
                FROM ({PHRASES}) WHERE t IN (0, 1, 2, 4))
            UNION ALL SELECT p_partkey, 0, 3 FROM ({PHRASES}) WHERE t = 5""",
        "protected_drop": f"""
            SELECT p_partkey, 'ipo@lot' || p_partkey || '.com' AS text, 'protected_span_skipped' AS fate
            FROM ({PHRASES}) WHERE t = 5
            UNION ALL SELECT p_partkey, 'pio@lot' || p_partkey || '.com', 'kept'
            FROM ({PHRASES}) WHERE t = 5""",
        "gate_reasons": f"""WITH {FATES_CTE} SELECT note_id, entity_type, s AS span_start,
            e AS span_end, source AS span_source, fate FROM fates""",
        "gate_tally": f"""WITH {FATES_CTE} SELECT reason, count(*) AS n FROM (
            SELECT unnest({COUNTERS}) AS reason FROM fates WHERE fate <> 'kept'
            UNION ALL SELECT 'private_organizations_anonymized' FROM fates WHERE entity_type = 'ORG'
            AND (fate = 'duplicate' OR fate = 'kept' AND source = 'regex')) GROUP BY reason""",
        "frequency_gate": """SELECT s_suppkey, CASE WHEN n > 50 THEN 0 ELSE n END AS kept,
            CASE WHEN n > 50 THEN n ELSE 0 END AS suppressed
            FROM (SELECT s_suppkey, 45 + s_suppkey % 12 AS n FROM supplier)""",
        "corpus_frequency": """SELECT text, entity_type, count(*) AS n FROM (
            SELECT *, count(*) OVER (PARTITION BY lower(text)) AS often FROM (
                SELECT CASE WHEN l_linenumber % 2 = 0 THEN 'Acme ' ELSE 'ACME ' END
                       || CAST(l_partkey AS STRING) AS text,
                CASE l_suppkey % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' ELSE 'EMAIL' END AS entity_type,
                l_suppkey % 4 = 0 AS sure FROM lineitem))
            WHERE entity_type = 'EMAIL' OR sure OR often <= 30 GROUP BY text, entity_type""",
        "confidence_gate": f"""WITH {FATES_CTE}, externals AS (SELECT note_id, s, e, fate FROM fates
                WHERE entity_type = 'PERSON' AND source IN ('spacy', 'presidio')
                UNION ALL SELECT {K}, length('Met '), length('Met ') + length('Rashi Patil'
                    || CAST({K} AS STRING)), 'kept' FROM customer WHERE {K} % {len(CASES)} = 25)
            SELECT note_id, s AS span_start, e AS span_end, substr(text, s + 1, e - s) AS text,
                   'PERSON' AS entity_type
            FROM externals JOIN (SELECT {K} AS note_id, {{TEXT}} AS text FROM customer) USING (note_id)
            WHERE fate IN ('kept', 'confidence')""",
        "model_recognizer": _model_rows(),
        "dedupe_spans": f"""WITH {LINES_CTE} SELECT l_orderkey, s AS span_start, e AS span_end, score,
            source FROM uniques""",
        "resolve_overlaps": f"""WITH RECURSIVE {LINES_CTE},
            ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey
                ORDER BY score DESC, e - s DESC, s) AS r FROM uniques),
            picked AS (
                SELECT l_orderkey, r, s, e, true AS keep, [{{'s': s, 'e': e}}] AS kept
                FROM ranked WHERE r = 1
                UNION ALL
                SELECT n.l_orderkey, n.r, n.s, n.e, list_count(hit) = 0,
                       CASE WHEN list_count(hit) = 0 THEN list_append(n.kept, {{'s': n.s, 'e': n.e}})
                       ELSE n.kept END
                FROM (SELECT x.l_orderkey, x.r, x.s, x.e, p.kept,
                             list_filter(p.kept, lambda q: q.s < x.e AND x.s < q.e) AS hit
                      FROM picked p JOIN ranked x ON x.l_orderkey = p.l_orderkey AND x.r = p.r + 1) n)
            SELECT l_orderkey, p.s AS span_start, p.e AS span_end, score, source
            FROM picked p JOIN ranked USING (l_orderkey, r) WHERE keep""",
        "type_counts": f"""SELECT coalesce(entity_type, '(all)') AS entity_type, count(*) AS n
            FROM ({ALL_HITS}) GROUP BY ROLLUP (entity_type)""",
        "detection_report": f"""WITH {NOTES_CTE}, found AS (SELECT * FROM notes WHERE kind IS NOT NULL)
            SELECT 'Total entities detected' AS metric, CAST(count(*) AS STRING) AS value FROM found
            UNION ALL SELECT 'Unique replacements', CAST(count(DISTINCT value) AS STRING) FROM found
            UNION ALL SELECT 'Detected ' || kind, CAST(count(*) AS STRING) FROM found GROUP BY kind
            UNION ALL SELECT unnest(['False positives', 'False negatives', 'Precision', 'Recall',
                'F1 Score', 'Accuracy']), 'N/A (ground truth not supplied)'""",
        "doc_stats": """SELECT count(*) AS paragraphs,
            CAST(sum(len(regexp_extract_all(line, '[^\\s\\x0b\\x1c-\\x1f]+'))) AS BIGINT) AS words,
            CAST(sum(length(line)) AS BIGINT) AS characters
            FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
            WHERE regexp_matches(line, '[^\\s\\x0b\\x1c-\\x1f]')""",
        "paragraph_lengths": """SELECT doc_id, CAST(i - 1 AS BIGINT) AS para_no, length(p[i]) AS n_chars
            FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i
                  FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))
            WHERE regexp_matches(p[i], '[^\\s\\x0b\\x1c-\\x1f]')""",
        "page_stats": """SELECT page_id, CAST(1 + (length(html) - length(replace(html, '<table', ''))) / 6
            AS BIGINT) AS tables, length(html) AS characters FROM pages""",
        "pseudonym_map": f"WITH {MAPPING_CTE} SELECT * FROM mapping",
        "fake_collisions": f"""WITH {NOTES_CTE} SELECT '<' || kind || '>' AS replacement,
            count(DISTINCT value) AS originals FROM notes WHERE kind IS NOT NULL
            GROUP BY kind HAVING count(DISTINCT value) > 1""",
        "redact_documents": f"""SELECT doc_id, coalesce(r, text) AS redacted FROM documents LEFT JOIN (
            SELECT doc_id, string_agg(substr(d.text, b + 1, span_start - b) || '<' || entity_type || '>', ''
                ORDER BY span_start) || substr(any_value(d.text), max(span_end) + 1) AS r
            FROM (SELECT *, coalesce(lag(span_end) OVER (PARTITION BY doc_id ORDER BY span_start), 0) AS b
                  FROM ({ALL_HITS})) h JOIN documents d USING (doc_id) GROUP BY doc_id) USING (doc_id)""",
        "redact_notes": f"""WITH {MAPPING_CTE} SELECT note_id, CASE WHEN kind IS NULL THEN text
            ELSE prefix || replacement || suffix END AS redacted
            FROM notes LEFT JOIN mapping ON value = original""",
        "redact_runs": f"""WITH {NOTES_CTE} SELECT note_id, run_no, CASE run_no
                WHEN 0 THEN prefix WHEN 1 THEN CASE WHEN found THEN '<' || kind || '>' ELSE left(value, 2) END
                WHEN 2 THEN CASE WHEN found THEN '' ELSE substr(value, 3, 3) END
                ELSE CASE WHEN found THEN '' ELSE substr(value, 6) END || suffix END AS run_text,
                CAST(found AS BIGINT) AS replacements
            FROM (SELECT *, kind IS NOT NULL AS found FROM notes), (SELECT unnest(range(0, 4)) AS run_no)""",
        "page_round_trip": """SELECT page_id, html || '<p title="4111111111111111">Paid by 4111 '
            || '<b>1111 1111</b> 1111 twice</p><p>4111 1111</p><p>1111 1111</p>' AS html FROM pages""",
        "literal_replace": """SELECT doc_id, replace(replace(replace(replace(text, 'ingtion', '<it>'),
            'tion', '<t>'), 'ing', '_'), 'e', '3') AS text FROM documents""",
        "table_replace": """WITH words AS (SELECT DISTINCT string_split(text, ' ')[1] AS o FROM documents
                WHERE length(string_split(text, ' ')[1]) >= 3),
            entries AS (SELECT list({'o': o, 'r': substr(o, 2) || 'e'} ORDER BY length(o) DESC, o) AS e FROM words)
            SELECT doc_id, list_reduce(list_prepend({'o': text, 'r': ''}, e),
                lambda a, x: {'o': replace(a.o, x.o, x.r), 'r': ''}).o AS text FROM documents, entries""",
        "exact_match_metrics": f"""WITH {TRUTH_CTE} SELECT tp, fp, fn,
            round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
            round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM cells""",
        "span_type_totals": f"""WITH {TRUTH_CTE} SELECT kind AS entity_type, count(*) FILTER (t) AS truth,
            count(*) FILTER (p) AS predicted FROM compared GROUP BY kind""",
        "char_accuracy": f"""WITH {TRUTH_CTE}, sides AS (
                SELECT n.note_id, length(n.text) AS len, t.s AS ts, t.e AS te, p.s AS ps, p.e AS pe
                FROM notes n LEFT JOIN truth t USING (note_id) LEFT JOIN predicted p USING (note_id)),
            counts AS (SELECT CAST(sum(len) AS BIGINT) AS characters, CAST(sum(len
                - len(list_filter(range(0, len), lambda i: coalesce(i >= ts AND i < te, false)
                  <> coalesce(i >= ps AND i < pe, false)))) AS BIGINT) AS agree FROM sides)
            SELECT characters, agree, round(agree / characters, 6) AS accuracy FROM counts""",
        "span_metrics_report": f"""WITH {TRUTH_CTE}, sides AS (
                SELECT n.note_id, length(n.text) AS len, t.s AS ts, t.e AS te, p.s AS ps, p.e AS pe
                FROM notes n LEFT JOIN truth t USING (note_id) LEFT JOIN predicted p USING (note_id)),
            counts AS (SELECT sum(len) AS characters, sum(len
                - len(list_filter(range(0, len), lambda i: coalesce(i >= ts AND i < te, false)
                  <> coalesce(i >= ps AND i < pe, false)))) AS agree FROM sides),
            kinds AS (SELECT kind, count(*) FILTER (t) AS nt, count(*) FILTER (p) AS np
                      FROM compared GROUP BY kind)
            SELECT unnest(['Total ground-truth entities', 'Total detected entities', 'True positives',
                'False positives', 'False negatives']) AS metric,
                CAST(unnest([tp + fn, tp + fp, tp, fp, fn]) AS STRING) AS value FROM cells
            UNION ALL SELECT unnest(['Precision', 'Recall', 'F1 Score']), format('{{:.6f}}',
                unnest([tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn)])) FROM cells
            UNION ALL SELECT 'Accuracy', format('{{:.6f}}', agree / characters) FROM counts
            UNION ALL SELECT 'Ground-truth entity counts', '{{' || string_agg('"' || kind || '":' || nt, ','
                ORDER BY kind) || '}}' FROM kinds WHERE nt > 0
            UNION ALL SELECT 'Detected entity counts', '{{' || string_agg('"' || kind || '":' || np, ','
                ORDER BY kind) || '}}' FROM kinds WHERE np > 0""",
        "binary_metrics": f"""WITH pairs AS (SELECT toxic = 1 AS t, doc_id IN (SELECT doc_id FROM
                ({_hits('EMAIL')} UNION ALL {_hits('CREDIT_CARD')})) AS p FROM labels
                JOIN documents USING (doc_id)),
            cells AS (SELECT count(*) AS total, count(*) FILTER (t AND p) AS tp,
                count(*) FILTER (NOT t AND p) AS fp, count(*) FILTER (t AND NOT p) AS fn FROM pairs)
            SELECT total, fp, fn, round((total - fp - fn) / total, 6) AS accuracy,
                coalesce(round(tp / nullif(tp + fp, 0), 6), 0) AS precision,
                coalesce(round(tp / nullif(tp + fn, 0), 6), 0) AS recall,
                coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0) AS f1 FROM cells""",
        "review_sheet": f"""WITH found AS (SELECT DISTINCT text AS original, lower(text) AS v, entity_type AS kind FROM ({ALL_HITS})),
            kinds AS (SELECT entity_type AS kind, count(*) AS spans FROM ({ALL_HITS}) GROUP BY entity_type),
            hits AS (SELECT original, kind, doc_id, d.text, strpos(lower(d.text), v) AS pos, length(v) AS n,
                (length(d.text) - length(replace(lower(d.text), v, ''))) / length(v) AS c
                FROM found JOIN documents d ON contains(lower(d.text), v))
            SELECT original, '<' || kind || '>' AS replacement, CAST(sum(c) AS BIGINT) AS original_occurrences,
                any_value(spans) AS replacement_occurrences, '' AS entity_type, '' AS notes,
                min_by(replace(replace(substr(text, greatest(pos - 100, 1), CAST(pos - greatest(pos - 100, 1)
                    + n + 100 AS BIGINT)), chr(13), ' '), chr(10), ' '), doc_id) AS source_context,
                '' AS is_actual_pii FROM hits JOIN kinds USING (kind) GROUP BY original, kind""",
        "word_occurrences": """WITH words AS (SELECT DISTINCT CASE c_custkey % 6 WHEN 0 THEN 'Th'
                WHEN 1 THEN 'ingin' WHEN 2 THEN 'E' WHEN 3 THEN 'the entionly' WHEN 4 THEN 'ANDTHE'
                ELSE 'Not There ' || CAST(c_custkey AS STRING) END AS value FROM customer)
            SELECT value, CAST(sum(len(string_split(lower(text), lower(value))) - 1) AS BIGINT) AS occurrences
            FROM words JOIN documents ON contains(lower(text), lower(value)) GROUP BY value""",
        "review_metrics": f"""WITH {NOTES_CTE}, sheet AS (SELECT value, kind = 'ADDRESS' AS wrong,
                count(*) AS n FROM notes WHERE kind IS NOT NULL GROUP BY value, kind),
            c AS (SELECT count(*) AS reviewed, count(*) FILTER (NOT wrong) AS tp,
                count(*) FILTER (wrong) AS fp, coalesce(CAST(sum(n) FILTER (NOT wrong) AS BIGINT), 0) AS tpo,
                coalesce(CAST(sum(n) FILTER (wrong) AS BIGINT), 0) AS fpo FROM sheet)
            SELECT reviewed, tp, fp, tpo AS tp_occurrences, fpo AS fp_occurrences,
                round(tp / reviewed, 6) AS precision, round(tp / (tp + 12), 6) AS recall,
                round(2 * tp / (2 * tp + fp + 12), 6) AS f1,
                round((tp + 30) / (reviewed + 42), 6) AS accuracy FROM c""",
        "stream_redaction": f"""SELECT conv_id, turn, replace(text, 'user' || CAST(conv_id AS STRING)
            || '@mail.example.com', '<EMAIL>') AS redacted FROM ({CHATS})""",
        "stream_mapping": f"""SELECT DISTINCT 'user' || CAST(conv_id AS STRING) || '@mail.example.com'
            AS original, 'EMAIL' AS entity_type, CASE WHEN conv_id % 3 = 0 THEN 'saved-' ||
            CAST(conv_id AS STRING) ELSE '<EMAIL>' END AS replacement FROM ({CHATS})""",
        "stream_mapped_texts": f"""SELECT conv_id, turn, replace(text, 'user' || CAST(conv_id AS STRING)
            || '@mail.example.com', CASE WHEN conv_id % 3 = 0 THEN 'saved-' || CAST(conv_id AS STRING)
            ELSE '<EMAIL>' END) AS redacted FROM ({CHATS})""",
        "docx_runs": """SELECT doc_id, CAST(i - 1 AS BIGINT) AS para_no, p[i] AS run_text
            FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i
                  FROM (SELECT doc_id, string_split(regexp_replace(text,
                        '[\\x00-\\x08\\x0b-\\x1f]', ' ', 'g'), chr(10)) AS p FROM documents))""",
        "docx_redaction": f"""WITH {NOTES_CTE}, masked AS (
                SELECT *, kind IS NOT NULL AS found, CASE WHEN kind IS NOT NULL THEN '<' || kind || '>' ELSE value END AS v FROM notes)
            SELECT note_id, 'body' AS story, 0::BIGINT AS para_no, run_no, CASE run_no
                WHEN 0 THEN prefix WHEN 1 THEN CASE WHEN found THEN v ELSE left(value, 2) END
                WHEN 2 THEN CASE WHEN found THEN '' ELSE substr(value, 3, 3) END
                ELSE CASE WHEN found THEN '' ELSE substr(value, 6) END || suffix END AS run_text
            FROM masked, (SELECT unnest(range(0, 4)) AS run_no)
            UNION ALL SELECT note_id, 'table', 1, run_no, CASE run_no WHEN 0 THEN prefix || v ELSE suffix END
            FROM masked, (SELECT unnest(range(0, 2)) AS run_no)
            UNION ALL SELECT note_id, 'header', 2, 0, prefix || v || suffix FROM masked""",
        "redact_pages": f"""SELECT page_id, {MASKED_PAGE} || {PLANTED_TAIL} AS redacted_html FROM pages""",
        "redact_page_bodies": f"""WITH {NOTES_CTE} SELECT page_id, replace({MASKED_PAGE}, '<article>', '<article><p>' ||
                CASE WHEN note_id IS NULL THEN '' ELSE prefix || CASE WHEN kind IS NULL THEN left(value, 2) || '<b>'
                || substr(value, 3) || '</b>' ELSE '<' || kind || '><b></b>' END || suffix END || '</p>')
            || {PLANTED_TAIL} AS redacted_html FROM pages LEFT JOIN notes ON page_id = note_id""",
    }
    texts = (f"CASE {K} % {len(CASES)} " + " ".join(
        f"WHEN {i} THEN {c.prefix} || {c.value} || {c.suffix}" for i, c in enumerate(CASES)) + " END")
    sql["confidence_gate"] = sql["confidence_gate"].replace("{TEXT}", texts)
    sql["distinct_type_counts"] = sql["type_counts"]
    return sql | _item_sql(sql)


def _item_sql(sql: dict[str, str]) -> dict[str, str]:
    """Twins of ``item_queries``."""
    values = f"WITH {NOTES_CTE}, v AS (SELECT DISTINCT value, kind FROM notes WHERE kind IS NOT NULL)"
    entries = dictionary_entries()
    inside = lambda entry: any(re.search(rf"(?<!\w){re.escape(p)}(?!\w)", f"x{entry}0") for p in PROTECTED_PHRASES)
    fates = {i: "protected_span_skipped" if inside(entry) else fate for i, (entry, fate) in enumerate(entries)}
    rechecked = " ".join(f"WHEN {i} THEN '{c.fate}'" for i, c in enumerate(CASES)
                         if c.fate in ("public_organization", "protected_term", "confidence"))
    gone = ", ".join(str(i) for i, c in enumerate(CASES) if c.fate is None)
    return {
        "saved_mapping": f"{values} SELECT value AS original, kind AS entity_type, 'x-' || value AS replacement FROM v",
        "legacy_mapping": f"{values} SELECT value AS original, 'x-' || value AS replacement FROM v",
        "ground_truth": f"""WITH {NOTES_CTE} SELECT CAST(note_id AS STRING) AS id, text, CASE WHEN kind IS NULL THEN 0 ELSE 1 END
            AS entities, CASE WHEN kind IS NOT NULL THEN s END AS first_start, kind AS first_type FROM notes""",
        "saved_review": f"""{values} SELECT value AS original, 'x, "' || value || '"' AS replacement, length(value) AS original_occurrences,
            'a' || chr(10) || value AS source_context, CASE WHEN kind = 'ORG' THEN 'no' ELSE 'yes' END AS is_actual_pii FROM v""",
        "saved_metrics": f"""SELECT row_number() OVER (ORDER BY rank, metric) - 1 AS position, metric, value FROM ({_ranked(sql)})""",
        "saved_report": f"""SELECT row_number() OVER (ORDER BY rank, line) - 1 AS line_no, line FROM (
            SELECT -2 AS rank, 'PII Redaction Evaluation Report' AS line UNION ALL SELECT -1, repeat('=', 34)
            UNION ALL SELECT rank, metric || ': ' || value FROM ({_ranked(sql)}))""",
        "saved_redacted": f"""WITH {NOTES_CTE} SELECT note_id, coalesce(kind, 'none') AS part, prefix || CASE WHEN kind IS NULL
            THEN value ELSE '<' || kind || '>' END || suffix AS redacted FROM notes""",
        "recheck": f"""SELECT {K} AS note_id, CASE {K} % {len(CASES)} {rechecked} ELSE 'kept' END AS fate FROM customer
            WHERE {K} % {len(CASES)} NOT IN ({gone})""",
        "blank_texts": f"SELECT {K} AS note_id, CASE WHEN {K} % 4 < 3 THEN 0 ELSE 2 END AS spans FROM customer",
        "binary_report": f"""SELECT metric, value FROM (SELECT unnest(['Accuracy', 'Precision', 'Recall', 'F1 Score',
            'Total entities evaluated', 'False positives', 'False negatives']) AS metric,
            unnest([format('{{:.6f}}', accuracy), format('{{:.6f}}', precision), format('{{:.6f}}', recall), format('{{:.6f}}', f1),
            CAST(total AS STRING), CAST(fp AS STRING), CAST(fn AS STRING)]) AS value FROM ({sql["binary_metrics"]}))""",
        "first_types": """SELECT value AS original, min_by(kind, l_orderkey * 10 + l_linenumber) AS entity_type, count(*) AS n
            FROM (SELECT *, 'Value ' || CAST(l_partkey % 500 AS STRING) AS value, CASE l_suppkey % 3 WHEN 0 THEN 'PERSON'
                WHEN 1 THEN 'ORG' ELSE 'EMAIL' END AS kind FROM lineitem) GROUP BY value""",
        "sheet_order": f"""{values} SELECT row_number() OVER (ORDER BY lower(value), value) - 1 AS position, value AS original
            FROM (SELECT DISTINCT value FROM v)""",
        "document_texts": f"""WITH {NOTES_CTE} SELECT note_id, prefix || value || chr(10) || suffix || chr(10) || value AS text FROM notes""",
        "seeded_fakes": f"{values} SELECT value AS original, kind AS entity_type, {_fake('kind', 'value', 7)} AS replacement FROM v",
        "dictionary_gates": f"""SELECT {K} AS note_id, CASE {K} % {len(entries)} """ + " ".join(
            f"WHEN {i} THEN '{fate}'" for i, fate in fates.items()) + " END AS fate FROM customer",
    }


def _ranked(sql: dict[str, str]) -> str:
    """The detection report with the order of its lines: totals, types by name, then what needs a truth."""
    last = ["False positives", "False negatives", "Precision", "Recall", "F1 Score", "Accuracy"]
    cases = " ".join(f"WHEN '{n}' THEN {i}" for i, n in
                     [(0, "Total entities detected"), (1, "Unique replacements"), *((10 + i, n) for i, n in enumerate(last))])
    return f"SELECT *, CASE metric {cases} ELSE 5 END AS rank FROM ({sql['detection_report']})"
