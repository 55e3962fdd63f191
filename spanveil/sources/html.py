"""Web pages as runs: text nodes are the runs, block-level markup ends a paragraph."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanveil.functions.arrays import add_columns, literal, settle, total, with_scans
from spanveil.functions.regex import MARK, NOT_SPACE, marked_pieces

MARKUP = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>"
INLINE = ("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q s samp small span "
          "strong sub sup time tt u var").split()
_INLINE_TAG = rf"(?i)^</?(?:{'|'.join(INLINE)})\b"


def page_runs(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``pieces`` (text, markup, text, ..) and ``paragraphs``.

    ``paragraphs`` is an array with one element per paragraph that has text:
    STRUCT<para_no, runs: ARRAY<STRUCT<run_no, run_text>>>; run_no is the place of the
    text in ``pieces``. Joining all pieces gives the page back.
    """
    df = add_columns(pages, {"pieces": marked_pieces(html, MARKUP, f"{MARK}$0{MARK}")})
    breaks = f"if(i % 2 = 1 AND NOT rlike(t, {literal(_INLINE_TAG)}), 1, 0)"
    df = with_scans(df, {"_para": f"transform(pieces, (t, i) -> {breaks})"}, 0, total)
    df = add_columns(df, {"_texts": (
        "filter(transform(zip_with(pieces, _para, (t, p) -> named_struct('t', t, 'p', p)), "
        "(x, i) -> named_struct('para_no', x.p, 'run_no', i, 'run_text', x.t)), "
        "r -> r.run_no % 2 = 0 AND r.run_text <> '')")})
    # Texts of one paragraph stand next to each other: cut where the number changes.
    df = add_columns(df, {"_heads": (
        "filter(transform(_texts, (r, i) -> if(i = 0 OR _texts[greatest(i - 1, 0)].para_no "
        "<> r.para_no, i, -1)), i -> i >= 0)")})
    return settle(df, {"paragraphs": (
        "transform(transform(_heads, (b, j) -> slice(_texts, b + 1, "
        "coalesce(get(_heads, j + 1), size(_texts)) - b)), g -> named_struct("
        "'para_no', g[0].para_no, 'runs', transform(g, r -> named_struct("
        "'run_no', r.run_no, 'run_text', r.run_text))))")}).drop("_para", "_texts", "_heads")


def page_paragraphs(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """Table form: keys, para_no, runs, text (of the joined runs), without blank paragraphs."""
    rows = page_runs(pages, html).select(*keys, F.inline("paragraphs"))
    text = F.array_join(F.transform("runs", lambda r: r["run_text"]), "")
    return rows.withColumn("text", text).where(F.col("text").rlike(NOT_SPACE))


def rebuild_pages(pages: DataFrame, rewritten: DataFrame, keys: list[str],
                  runs: str = "redacted_runs", output: str = "redacted_html",
                  html: str = "html") -> DataFrame:
    """Put rewritten runs back into their pages.

    ``rewritten`` only needs the paragraphs that changed; the runs of one page are
    gathered, never more. Other pages keep their text.
    """
    changed = rewritten.select(*keys, F.explode(runs).alias("r")).groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("r.run_no", "r.run_text"))).alias("_new"))
    df = add_columns(pages, {"pieces": marked_pieces(html, MARKUP, f"{MARK}$0{MARK}")}).join(
        changed, keys, "left")
    return add_columns(df, {output: (
        f"if(_new IS NULL, {html}, array_join(transform(pieces, (t, i) -> "
        f"coalesce(try_element_at(_new, i), t)), ''))")}).drop("pieces", "_new")
