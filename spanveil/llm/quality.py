"""Quality rules as a ledger of failure bits.

Every rule is evaluated once per document: the ledger stores one bit per failed rule beside the
measurements. A policy is a named version of a set of rules; applying one is a bitwise AND, so new
policies and ablations (what would be kept without a rule) never read the texts again: documents are
counted per distinct set of failures, and bitwise operations on those few rows give all figures.

Built-in functions only, row-local: no shuffle but for the ablation's counts. Words repeated in
windows are found by sorting the window hashes of each text, so a long text costs n log n.

A null text has no words and fails ``few_words``. Repeated rows and nulls in other columns do not
matter; columns named like the ledger's are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from spanveil.functions.arrays import settle

BLANK = "[\\\\x20\\\\x09-\\\\x0D]"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: A rule holds the condition under which a document fails; its place is its bit.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "repeated_lines": "100 * n_dup_lines > 30 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 12 * n_words",
}
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "repeated_lines"),
    "v2": tuple(RULES),
}


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the measurements (all long)."""
    df = docs.drop(*MEASURES)
    kept = df.columns
    df = settle(df, {"_quality_text": f"coalesce(CAST(`{text}` AS STRING), '')"})
    df = settle(df, {
        "_quality_words": f"array_remove(split(_quality_text, '{BLANK}+'), '')",
        "_quality_lines": f"filter(split(_quality_text, '\\\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"})
    df = settle(df, {
        "n_words": "CAST(size(_quality_words) AS BIGINT)",
        "word_chars": "CAST(char_length(array_join(_quality_words, '')) AS BIGINT)",
        "n_symbols": "CAST(regexp_count(_quality_text, '[#*$%&|<>]') AS BIGINT)",
        "n_lines": "CAST(size(_quality_lines) AS BIGINT)",
        "n_dup_lines": "CAST(size(_quality_lines) - size(array_distinct(_quality_lines)) AS BIGINT)",
        "_quality_windows": ("sort_array(transform(if(size(_quality_words) < 3, CAST(array() AS ARRAY<INT>), sequence(0, size(_quality_words) - 3)), "
                     "i -> named_struct('h', xxhash64(_quality_words[i], _quality_words[i + 1], _quality_words[i + 2]), 'i', i)))")})
    df = settle(df, {"_quality_at": (
        "sort_array(transform(filter(_quality_windows, (w, i) -> (i > 0 AND _quality_windows[greatest(i - 1, 0)].h = w.h) OR "
        "(i < size(_quality_windows) - 1 AND _quality_windows[least(i + 1, size(_quality_windows) - 1)].h = w.h)), w -> w.i))")})
    df = settle(df, {"n_repeat_words": (
        "aggregate(_quality_at, named_struct('n', 0L, 'to', 0), (a, i) -> named_struct("
        "'n', a.n + (i + 3 - greatest(i, a.to)), 'to', i + 3), a -> a.n)")})
    return df.select(*[F.col(f"`{c}`") for c in kept], *MEASURES)


def failures(rules: dict[str, str] = RULES) -> Column:
    """One bit per failed rule."""
    out = F.lit(0).cast("bigint")
    for bit, condition in enumerate(rules.values()):
        out = out.bitwiseOR(F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)).cast("bigint"))
    return out


def ledger(docs: DataFrame, text: str = "text", rules: dict[str, str] = RULES) -> DataFrame:
    """Add the measurements and ``failures``."""
    return measure(docs.drop("failures"), text).withColumn("failures", failures(rules))


def mask(policy: str, rules: dict[str, str] = RULES, policies: dict[str, tuple[str, ...]] = POLICIES) -> int:
    names = list(rules)
    return sum(1 << names.index(r) for r in policies[policy])


def apply_policy(df: DataFrame, policy: str = "v2", column: str = "kept", rules: dict[str, str] = RULES,
                 policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """Add the verdict of a policy on the ledger."""
    return df.withColumn(column, F.col("failures").bitwiseAND(F.lit(mask(policy, rules, policies))) == 0)


def ablation(df: DataFrame, policy: str = "v2", rules: dict[str, str] = RULES,
             policies: dict[str, tuple[str, ...]] = POLICIES) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail nothing else, and kept without it."""
    whole = mask(policy, rules, policies)
    sets = df.groupBy(F.col("failures").bitwiseAND(F.lit(whole)).alias("f")).agg(F.count("*").alias("n"))
    bits = [(r, 1 << list(rules).index(r)) for r in policies[policy]]
    options = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(b).cast("bigint").alias("bit")) for r, b in bits]))
    rows = sets.select("f", "n", options.alias("o"))
    failed, other = F.col("f").bitwiseAND(F.col("o.bit")) != 0, F.col("f").bitwiseAND(F.bitwise_not("o.bit"))
    return rows.groupBy(F.col("o.rule").alias("rule")).agg(
        F.sum(F.when(failed, F.col("n")).otherwise(0)).alias("failing"),
        F.sum(F.when(failed & (other == 0), F.col("n")).otherwise(0)).alias("failing_only"),
        F.sum(F.when(other == 0, F.col("n")).otherwise(0)).alias("kept_without"),
        F.bit_or("f").alias("any_failures"))
