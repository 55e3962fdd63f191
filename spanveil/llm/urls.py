"""URL filters: given rules first, then association rules mined with FP-growth.

Given rules (host, path prefix) hold for a host and its subdomains; the longest that fits decides.
Decided URLs are labelled with their verdict, all others with none: Spark's FP-growth mines frequent
combinations of tokens (host labels, path segments with digits folded, query names, fragment mark)
and labels over all URLs. A combination becomes a rule when enough of ALL URLs that have it carry
one verdict; undecided ones count against it, so what the rules say nothing about is left alone.
Rules that a shorter one with the same verdict and no less confidence covers are pruned. Undecided URLs meet them
through an inverted index (token -> rules): a rule fits when all its tokens are there; the most
confident one decides, then the best supported, then block. No rule: the default verdict.

All rows are mined, none sampled. What comes out is bounded by the support: at most 1 / support
frequent tokens per token place of a URL, and rules of at most ``LARGEST`` of them.

A null url, or one without '://', has an empty host and path, no tokens but the scheme-less mark,
and gets the default verdict unless a rule says otherwise. Repeated rows are judged alike. Null ids
are kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, functions as F

from spanveil.llm.common import hold

#: (verdict, host, path): fixed rules of the registered query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SUPPORT, CONFIDENCE, LARGEST = 0.002, 0.7, 3
BLOCK, ALLOW, NONE = "verdict=block", "verdict=allow", "verdict=none"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + F.lit(3), F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + F.lit(1), F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def matching_rule(rules=RULES) -> tuple[Column, Column]:
    """The longest rule (its text, its verdict) that fits columns host and path, else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # longer ones wrap shorter ones
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        text, verdict = F.when(fits, host + path).otherwise(text), F.when(fits, says).otherwise(verdict)
    return text, verdict


def tokens(url: Column) -> Column:
    """Distinct tokens of a url, from columns host and path too."""
    folded = F.regexp_replace("path", "[0-9]+", "0")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), "^[^?#]*\\?([^#]*)", 1)
    return F.array_distinct(F.concat(
        F.transform(F.filter(F.split("host", "\\."), lambda x: x != ""), lambda x: F.concat(F.lit("host:"), x)),
        F.transform(F.filter(F.split(folded, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), x)),
        F.transform(F.filter(F.split(query, "&"), lambda x: x != ""),
                    lambda x: F.concat(F.lit("query:"), F.substring_index(x, "=", 1))),
        F.array(F.when(F.coalesce(url, F.lit("")).contains("#"), "fragment").otherwise("no fragment"))))


def mine(urls: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE, largest: int = LARGEST) -> DataFrame:
    """Rules (rule_id, antecedent, verdict, confidence, support) from columns tokens and verdict (null: none)."""
    items = urls.select(F.concat("tokens", F.array(F.concat(F.lit("verdict="), F.coalesce("verdict", F.lit("none"))))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(items)
    rules = model.associationRules.where(
        (F.element_at("consequent", 1).isin(BLOCK, ALLOW)) & (F.size("antecedent") <= largest)
        & ~F.exists("antecedent", lambda x: x.isin(BLOCK, ALLOW, NONE)))
    rules = hold(rules.select(
        F.array_sort("antecedent").alias("antecedent"),
        F.substring_index(F.element_at("consequent", 1), "=", -1).alias("verdict"), "confidence", "support").withColumn(
        "rule_id", F.xxhash64("antecedent", "verdict")), "mined")
    # a rule is superfluous when one with a part of its tokens says the same as surely
    parts = rules.select("rule_id", "verdict", "confidence", F.size("antecedent").alias("size"),
                         F.explode("antecedent").alias("token"))
    short = parts.select(F.col("rule_id").alias("by"), "verdict", F.col("confidence").alias("sure"),
                         F.col("size").alias("small"), "token")
    covered = (parts.join(short, ["verdict", "token"]).where("small < size AND sure >= confidence")
               .groupBy("rule_id", "by", "small").count().where("count = small").select("rule_id").distinct())
    return rules.join(covered, "rule_id", "left_anti")


def judge(pages: DataFrame, key: str = "page_id", url: str = "url", rules=RULES, default: str = "allow",
          support: float = SUPPORT, confidence: float = CONFIDENCE, largest: int = LARGEST) -> DataFrame:
    """Per row: key, host, path, rule, verdict."""
    host, path = host_and_path(F.col("url"))
    seen = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url")).withColumns(
        {"host": host, "path": path})
    rule, verdict = matching_rule(rules)
    seen = seen.withColumns({"rule": rule, "verdict": verdict, "tokens": tokens(F.col("url"))})
    seen = hold(seen.withColumn("nr", F.monotonically_increasing_id()), "urls")

    mined = mine(seen, support, confidence, largest)
    index = mined.select("rule_id", "verdict", "confidence", "support", F.size("antecedent").alias("size"),
                         F.explode("antecedent").alias("token"))
    # equal sets of tokens are matched once
    undecided = seen.where("verdict IS NULL").select(F.xxhash64(F.array_sort("tokens")).alias("set"), "tokens").dropDuplicates(["set"])
    fits = (undecided.select("set", F.explode("tokens").alias("token")).join(index, "token")
            .groupBy("set", "rule_id").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("verdict").alias("v"),
                                           F.first("confidence").alias("confidence"), F.first("support").alias("support"))
            .where("n = size"))
    best = fits.groupBy("set").agg(F.max(F.struct("confidence", "support", "v")).alias("best")).select("set", F.col("best.v").alias("mined"))
    # decided rows take no part in the join: their sets would all be null, one key
    open_ = seen.where("verdict IS NULL").withColumn("set", F.xxhash64(F.array_sort("tokens"))).join(best, "set", "left")
    out = seen.where("verdict IS NOT NULL").withColumn("mined", F.lit(None).cast("string")).unionByName(open_.drop("set"))
    return out.select(F.col("key").alias(key), "host", "path", "rule", F.coalesce("verdict", "mined", F.lit(default)).alias("verdict"))
