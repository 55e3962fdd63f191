"""SQL twins of the queries of this folder, where SQL can express them."""

from __future__ import annotations

import string

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
WORDS = "list_filter(string_split_regex({}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
ALNUM = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _low(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{UPPER}', '{LOWER}')"


NGRAM_JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, {WORDS.format(_low("text"))} AS w FROM documents),
shingles AS (
    SELECT doc_id, s FROM (
        SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 2, 2)),
            lambda i: array_to_string(w[i:i + 3], ' ')))) AS s FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b USING (s)
    WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (
    SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
    WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reached AS (
    SELECT doc_id AS a, doc_id AS b FROM documents
    UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN reached r ON r.a = d.doc_id GROUP BY d.doc_id, s.n"""

SUBSTRINGS = f"""
WITH words AS (SELECT doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS (
    SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM (
        SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words)),
hit AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY s) AS first FROM windows) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, (SELECT unnest(range(50)) AS k)),
lost AS (SELECT doc_id, count(*) AS n, list(i) AS at FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
    sha256(CASE WHEN n IS NULL THEN array_to_string(w, ' ') ELSE coalesce(kept, '') END) AS kept_sha256
FROM words LEFT JOIN lost USING (doc_id) LEFT JOIN (
    SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS kept FROM (
        SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM words) p
    LEFT JOIN gone g ON g.doc_id = p.doc_id AND g.i = p.i
    WHERE g.i IS NULL AND p.doc_id IN (SELECT doc_id FROM lost) GROUP BY p.doc_id) USING (doc_id)"""

WARC = f"""
WITH rows AS (
    SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n,
        sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY h, n) AS first FROM rows)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + CAST((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT), 1)), '')
        AS payload_digest,
    CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to
FROM firsts"""

QUALITY = f"""
WITH words AS (
    SELECT doc_id, coalesce(text, '') AS text, {WORDS.format("coalesce(text, '')")} AS w,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
    FROM documents),
windows AS (
    SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s
    FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM windows) WHERE n > 1),
covered AS (
    SELECT doc_id, count(*) AS n FROM (
        SELECT DISTINCT doc_id, i + k FROM twice, (SELECT unnest(range(3)) AS k)) GROUP BY doc_id),
measured AS (
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words
    FROM words LEFT JOIN covered USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines
         OR word_chars < 2 * n_words OR word_chars > 12 * n_words) AS kept
FROM judged"""

DECONTAMINATE = f"""
WITH words AS (SELECT doc_id, {ALNUM.format(_low("text"))} AS w FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {ALNUM.format(_low("text"))} AS w FROM benchmark),
tests AS (
    SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (
        SELECT item, w, least(len(w), 13) AS k, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
        FROM items WHERE len(w) > 0)),
found AS (
    SELECT p.doc_id, p.i, p.k, t.item FROM (
        SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (
            SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i
            FROM words, (SELECT DISTINCT k FROM tests))) p
    JOIN tests t ON t.k = p.k AND t.s = p.s),
hit AS (
    SELECT doc_id, count(*) AS n FROM (
        SELECT DISTINCT doc_id, unnest(range(i, i + k)) FROM found) GROUP BY doc_id),
per AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
    FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit,
    CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
    coalesce(n > 0 AND 20 * n >= len(w), FALSE) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN per USING (doc_id)"""


# CRC-32 of a conversation's id in decimal, bit by bit: a character enters at the first of its eight steps.
CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST({} AS VARCHAR), ''),
    lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda x, y: CASE WHEN xor(x, y) % 2 = 1 THEN xor(xor(x, y) >> 1, 3988292384) ELSE xor(x, y) >> 1 END), 4294967295)"""

TRIE = f"""
WITH turns AS (
    SELECT conv_id, md5(length(r) || ':' || r || t) AS h, len({WORDS.format("t")}) AS w, turn
    FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations WHERE conv_id IS NOT NULL)),
own AS (SELECT conv_id AS c, list({{'h': h, 'w': w}} ORDER BY turn NULLS FIRST, h) AS s FROM turns GROUP BY conv_id),
whole AS (
    SELECT c, list_concat(coalesce(f.s[1:k], []), own.s[k + 1:]) AS s
    FROM (SELECT *, {CRC.format("c")} % 4 AS k FROM own) own LEFT JOIN (SELECT c AS d, s FROM own) f ON d = c - c % 20),
prefixes AS (
    SELECT c, len(s) AS size, d, array_to_string(list_transform(s[1:d], lambda x: x.h), '') AS p,
        array_to_string(list_transform(s[1:d - 1], lambda x: x.h), '') AS above, CASE WHEN d > 0 THEN s[d].w ELSE 0 END AS w
    FROM (SELECT c, s, unnest(range(0, len(s) + 1)) AS d FROM whole)),
nodes AS (
    SELECT p, d, min(c) AS low, count(*) AS n, any_value(above) AS above, any_value(w) AS w,
        sha256(coalesce(string_agg(c, ',' ORDER BY c) FILTER (size = d), '')) AS ends
    FROM prefixes GROUP BY p, d),
kids AS (SELECT above, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY above, d),
full_ AS (SELECT n.*, coalesce(k, 0) AS k FROM nodes n LEFT JOIN kids ON kids.above = n.p AND kids.d = n.d),
totals AS (
    SELECT up, count(*) FILTER (k = 0) AS leaves, sum((n - 1) * w) AS saved
    FROM (SELECT k, n, w, left(p, 32 * unnest(range(0, d + 1))) AS up FROM full_) GROUP BY up)
SELECT a.low AS conv_id, a.d AS depth, b.low AS parent_conv_id, a.n AS n_convs, a.k AS n_children,
    leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, a.ends AS ends_sha256
FROM full_ a JOIN totals ON up = a.p LEFT JOIN nodes b ON a.d > 0 AND b.p = a.above"""

EXACT = """
WITH digests AS (
    SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
    doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM digests WINDOW same AS (PARTITION BY text_sha256)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard": NGRAM_JACCARD, "op4_substrings": SUBSTRINGS, "op7_warc": WARC,
            "op8_quality_rules": QUALITY, "op9_decontaminate": DECONTAMINATE, "op11_prefix_trie": TRIE,
            "op12_exact_dedup": EXACT}
