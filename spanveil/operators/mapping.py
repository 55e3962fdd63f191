"""The mapping from original values to fakes, and its use on spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from spanveil.functions import dictionaries as D
from spanveil.functions.pseudonyms import SEED, Generator, fake
from spanveil.functions.text import casefold
from spanveil.operators.detect import explode_spans
from spanveil.operators.skew import join_by_value



def first_types(spans: DataFrame, order: list[str]) -> DataFrame:
    """One row per value: the type of its first appearance, and its number of spans.

    ``order`` are columns that, with the start of the span, put spans in order.
    Partial aggregation reduces each task to its distinct values before the shuffle.
    """
    return spans.groupBy(F.col("text").alias("original")).agg(
        F.min_by("entity_type", F.struct(*order, "start")).alias("entity_type"),
        F.count("*").alias("n"))


def extend_mapping(values: DataFrame, existing: DataFrame | None = None, *, seed: int = SEED,
                   generators: dict[str, Generator] | None = None) -> DataFrame:
    """Mapping (original, entity_type, replacement) for ``values`` (original, entity_type).

    Entries of ``existing`` win and stay, also when their value does not occur.
    Both sides have one row per value, so the joins cannot be skewed.
    """
    new = values.select("original", "entity_type")
    if existing is not None:
        new = new.join(existing.select("original"), "original", "left_anti")
    made = new.withColumn("replacement", F.expr(fake("entity_type", "original", seed, generators)))
    if existing is None:
        return made
    return existing.select("original", "entity_type", "replacement").unionByName(made)


def build_mapping(detected: DataFrame, keys: list[str], existing: DataFrame | None = None, *,
                  spans: str = "spans", seed: int = SEED,
                  generators: dict[str, Generator] | None = None) -> DataFrame:
    """Mapping for all values in the spans of ``detected``; ``keys`` identify and order texts."""
    firsts = first_types(explode_spans(detected, keys, spans), keys)
    return extend_mapping(firsts, existing, seed=seed, generators=generators)


def shared_fakes(mapping: DataFrame) -> DataFrame:
    """Fakes that stand for more than one original."""
    return mapping.groupBy("replacement").agg(F.count("*").alias("originals")).where("originals > 1")


def look_up(spans: DataFrame, mapping: DataFrame, value: str = "text") -> DataFrame:
    """Add ``replacement`` to spans by value; null where the mapping has none."""
    return join_by_value(spans, mapping.select(F.col("original").alias(value), "replacement"), value)


def suppress_frequent_in_corpus(spans: DataFrame, limit: int = D.FREQUENCY_LIMIT) -> DataFrame:
    """Drop PERSON/ORG spans below 0.995 whose value occurs more than ``limit`` times overall.

    The table-wide form of the frequency rule inside one text. ``spans`` is read
    twice: pass a table or a checkpoint.
    """
    folded = spans.withColumn("_folded", F.expr(casefold("text")))
    often = folded.groupBy("_folded").agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    tagged = join_by_value(folded, often, "_folded")
    frequent = F.col("entity_type").isin("PERSON", "ORG") & (F.col("score") < D.FREQUENCY_SCORE) & (
        F.col("_n").isNotNull())
    return tagged.where(~frequent).drop("_folded", "_n")


def with_replacements(detected: DataFrame, keys: list[str], mapping: DataFrame, *,
                      spans: str = "spans", output: str = "fakes") -> DataFrame:
    """Add the replacements of each text's spans, in span order: ARRAY<STRING>.

    ``keys`` identify a text. ``detected`` is read several times: pass a table or a
    checkpoint. Texts without spans take no part in any shuffle.
    """
    some, none = detected.where(F.size(spans) > 0), detected.where(F.size(spans) == 0)
    values = some.select(*keys, F.posexplode(F.transform(spans, lambda s: s["text"])).alias(
        "_pos", "text"))
    per_text = look_up(values, mapping).groupBy(*keys).agg(F.transform(
        F.sort_array(F.collect_list(F.struct("_pos", "replacement"))),
        lambda x: x["replacement"]).alias(output))
    return some.join(per_text, keys, "left").unionByName(
        none.withColumn(output, F.array().cast("array<string>")))
