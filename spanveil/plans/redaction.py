"""End-to-end redaction of a table of texts."""

from __future__ import annotations

import tempfile
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from spanveil.functions.pseudonyms import SEED, Generator
from spanveil.operators.detect import detect
from spanveil.operators.mapping import build_mapping, with_replacements
from spanveil.operators.redact import redact


class Redaction(NamedTuple):
    detected: DataFrame   # texts with spans
    mapping: DataFrame    # original, entity_type, replacement
    redacted: DataFrame   # texts with the column ``redacted``


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one in local mode where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spanveil-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared one; it goes when the session's JVM ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage of a frame that is read several times: a reliable checkpoint.

    The folder is the shared one, so checkpoints survive lost executors; it goes with the session.
    """
    spark: SparkSession = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(new_folder(spark, "checkpoints"))
    return df.checkpoint()


def redact_table(texts: DataFrame, keys: list[str], existing: DataFrame | None = None, *,
                 text_col: str = "text", seed: int = SEED,
                 generators: dict[str, Generator] | None = None, **options) -> Redaction:
    """Detect once, extend the mapping, and write the mapping's fakes into the texts.

    ``keys`` identify a text and put texts in order (for the first appearance of a
    value). Texts are detected once and kept; the mapping is kept too, since it is
    used more than once.
    """
    detected = keep(detect(texts.select(*keys, text_col), text_col, **options))
    mapping = keep(build_mapping(detected, keys, existing, seed=seed, generators=generators))
    redacted = redact(with_replacements(detected, keys, mapping), text_col, fakes="fakes",
                      seed=seed, generators=generators)
    return Redaction(detected, mapping, redacted.drop("fakes"))
