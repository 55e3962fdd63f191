"""Redaction of streams of texts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from spanveil.functions.pseudonyms import SEED, Generator
from spanveil.operators.detect import detect, explode_spans
from spanveil.operators.mapping import extend_mapping, first_types, with_replacements
from spanveil.operators.redact import redact
from spanveil.schema import MAPPING
from spanveil.streaming import store


def redact_stream(texts: DataFrame, text_col: str = "text", *, seed: int = SEED,
                  generators: dict[str, Generator] | None = None, **options) -> DataFrame:
    """Stateless redaction: works on a stream as on a table.

    Fakes are computed from type and value, so no state is kept and the result does
    not depend on how the stream is cut into batches.
    """
    return redact(detect(texts, text_col, **options), text_col, seed=seed, generators=generators)


def job_of(spark: SparkSession, checkpoint: str) -> str:
    """The name of the job of a checkpoint: made once, kept beside the stream's own state."""
    folder = f"{checkpoint}/mapping-job"
    system, path = store.files(spark, folder)
    if not system.exists(path):
        system.mkdirs(path)
        system.createNewFile(spark._jvm.org.apache.hadoop.fs.Path(path, uuid.uuid4().hex))
    return store.names(spark, folder)[0]


def mapped_batch(detected: DataFrame, batch_id: int, keys: list[str], mapping_path: str, *,
                 job: str = "job", existing: DataFrame | None = None, text_col: str = "text",
                 seed: int = SEED, generators: dict[str, Generator] | None = None) -> DataFrame:
    """Redact one detected batch with the mapping so far; add its new values to the mapping.

    Known is what ``existing`` and the mapping folder hold, of any job, but for the entries
    that this job made in this batch or later: a repeated batch ignores what it wrote before
    and writes the same again, so retries change nothing. Only the hash buckets of the
    mapping that the batch touches are read.
    """
    spark = detected.sparkSession
    values = first_types(explode_spans(detected, keys), keys)
    touched = [r[0] for r in values.select(store.bucket_of("original").alias("b")).distinct().collect()]
    entries = store.stream_entries(spark, mapping_path).where(F.col("bucket").isin(touched))
    own = F.coalesce((F.col("job") == job) & (F.col("batch_id") >= batch_id), F.lit(False))
    known = entries.where(~own).select("original", "entity_type", "replacement", F.struct(
        F.lit(1).alias("place"), "job", "batch_id").alias("rank"))
    if existing is not None:
        known = known.unionByName(existing.select("original", "entity_type", "replacement", F.struct(
            F.lit(0).alias("place"), F.lit(None).cast("string").alias("job"),
            F.lit(None).cast("bigint").alias("batch_id")).alias("rank")))
    # Only entries for values of this batch are needed; the batch is the small side.
    relevant = known.join(values.select("original"), "original", "left_semi").groupBy("original").agg(
        F.min_by(F.struct("entity_type", "replacement"), "rank").alias("e")).select(
        "original", "e.entity_type", "e.replacement")
    new = extend_mapping(values.join(relevant, "original", "left_anti"), seed=seed,
                         generators=generators)
    folder = store.append(new, mapping_path, job, batch_id)
    mapping = relevant.unionByName(spark.read.schema(f"{MAPPING}, bucket int").parquet(folder).drop("bucket"))
    return redact(with_replacements(detected, keys, mapping), text_col, fakes="fakes", seed=seed,
                  generators=generators).drop("fakes")


def redact_with_mapping(texts: DataFrame, keys: list[str], mapping_path: str, output_path: str,
                        checkpoint: str, *, existing: DataFrame | None = None,
                        text_col: str = "text", seed: int = SEED,
                        generators: dict[str, Generator] | None = None,
                        trigger: dict | None = None, **options) -> StreamingQuery:
    """Stream texts to redacted texts while the mapping grows from batch to batch.

    Output and mapping are written per batch number, the mapping also per job (kept with the
    checkpoint), so both are exactly-once and a new checkpoint never touches older entries.
    The mapping starts from ``existing`` and from all that ``mapping_path`` holds, whether a
    stream or ``write_mapping`` put it there. Closed batches are sealed into segments on the
    way (``streaming.store``), so a batch opens a bounded number of files however long the stream is.
    """
    job = job_of(texts.sparkSession, checkpoint)
    staging = f"{checkpoint}/staging"

    def write(batch: DataFrame, batch_id: int) -> None:
        store.compact(batch.sparkSession, mapping_path, job, batch_id)
        # A batch is read several times: write what was detected and go on from the table.
        # Batches follow each other, so one folder per stream is enough.
        detect(batch, text_col, **options).write.mode("overwrite").parquet(staging)
        detected = batch.sparkSession.read.parquet(staging)
        mapped_batch(detected, batch_id, keys, mapping_path, job=job, existing=existing,
                     text_col=text_col, seed=seed, generators=generators).write.mode("overwrite").parquet(
            f"{output_path}/batch_id={batch_id}")

    return (texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
