"""Tables of texts, mappings, ground truth, review sheets, metrics and reports."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException as SparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from spanveil.functions.regex import NOT_SPACE
from spanveil.schema import GROUND_TRUTH, MAPPING, METRICS, REVIEW


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for a scan that yields fewer splits than there are cores.

    Long texts in few files are cheap to move and expensive to search. A scan with
    enough splits is left as it is, so large tables are not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def paragraphs(df: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row per non-blank line: keys, para_no (counting all lines), text."""
    lines = df.select(*keys, F.posexplode(F.split(text_col, "\n", -1)).alias("para_no", "text"))
    return lines.where(F.col("text").rlike(NOT_SPACE))


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def read_mapping(spark: SparkSession, path: str, fmt: str = "parquet",
                 unreadable: str = "empty") -> DataFrame:
    """The saved mapping; empty if there is none, or if it cannot be read (or "error" then)."""
    if not _exists(spark, path):
        return spark.createDataFrame([], MAPPING)
    try:
        # without a schema Spark reads the files' own, so that unreadable ones show now
        spark.read.option("mergeSchema", True).format(fmt).load(path).schema
    except (AnalysisException, Py4JJavaError, SparkException):
        if unreadable != "empty":
            raise
        return spark.createDataFrame([], MAPPING)
    return spark.read.schema(MAPPING).format(fmt).load(path).where(
        "original IS NOT NULL AND replacement IS NOT NULL")


def read_legacy_mapping(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object original -> replacement; anything else gives an empty mapping."""
    if not _exists(spark, path):
        return spark.createDataFrame([], MAPPING)
    whole = spark.read.text(path, wholetext=True)
    pairs = whole.select(F.explode(F.from_json("value", "map<string,string>")))
    return pairs.select(F.col("key").alias("original"), F.lit(None).cast("string").alias(
        "entity_type"), F.col("value").alias("replacement")).where("replacement IS NOT NULL")


def write_mapping(mapping: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Save a mapping, sorted by original."""
    mapping.select("original", "entity_type", "replacement").orderBy("original").write.mode(
        "overwrite").format(fmt).save(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Annotated documents: id, text, entities. Malformed documents raise an error.

    An entity list that is not there fails, an empty one does not.
    """
    raw = spark.read.schema(GROUND_TRUTH).option("multiLine", True).option(
        "mode", "FAILFAST").json(path)
    checked = raw.select(F.when(
        F.coalesce(F.size("documents"), F.lit(0)) > 0, F.col("documents")).otherwise(
        F.raise_error(F.lit("Ground truth needs a non-empty 'documents' list"))).alias("d"))
    docs = checked.select(F.explode("d").alias("d"))
    required = {"text": "Each document needs a string 'text'",
                "entities": "Each document needs an 'entities' list"}
    return docs.select("d.id", *[
        F.when(F.col(f"d.{n}").isNotNull(), F.col(f"d.{n}")).otherwise(
            F.raise_error(F.lit(message))).alias(n) for n, message in required.items()])


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """A filled-in review sheet."""
    return spark.read.schema(REVIEW).csv(path, header=True, multiLine=True, escape='"')


def write_review(review: DataFrame, path: str) -> None:
    review.write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=True,
                                       emptyValue="")


def _placed(metrics: DataFrame) -> DataFrame:
    """A metrics frame with positions; one without them counts as it comes."""
    return metrics if "position" in metrics.columns else metrics.withColumn("position", F.monotonically_increasing_id())


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Two-column CSV (Metric, Value), in the order of the positions: one file, a metrics frame is small."""
    _placed(metrics).coalesce(1).sortWithinPartitions("position").select(
        F.col("metric").alias("Metric"), F.col("value").alias("Value")).write.mode("overwrite").csv(
        path, header=True, escape='"')


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A metrics frame from what ``write_metrics`` wrote."""
    return spark.read.schema("metric string, value string").csv(path, header=True, escape='"').select(
        F.monotonically_increasing_id().cast("int").alias("position"), "metric", "value")


# Head of the text report.
REPORT_TITLE = "PII Redaction Evaluation Report"
REPORT_RULE = "=" * 34


def report_lines(metrics: DataFrame) -> DataFrame:
    """``name: value`` lines under a title; fractional numbers with four decimals.

    Works on one array: a metrics frame has a fixed number of rows plus one per type.
    """
    value = F.when(F.col("value").rlike(r"^-?\d+\.\d+(?:[eE]-?\d+)?$"),
                   F.format_string("%.4f", F.col("value").try_cast("double"))).otherwise(
        F.col("value"))
    lines = _placed(metrics).select(F.struct("position", F.concat_ws(": ", "metric", value).alias("line")).alias("l"))
    rows = lines.agg(F.transform(F.sort_array(F.collect_list("l")), lambda l: l["line"]).alias("lines"))
    head = F.array(F.lit(REPORT_TITLE), F.lit(REPORT_RULE))
    return rows.select(F.explode(F.concat(head, "lines")).alias("value"))


def write_report(metrics: DataFrame, path: str) -> None:
    report_lines(metrics).coalesce(1).write.mode("overwrite").text(path)


def write_redacted(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


__all__ = ["METRICS", "paragraphs", "read_ground_truth", "read_legacy_mapping", "read_mapping",
           "read_metrics", "read_review", "report_lines", "spread", "write_mapping", "write_metrics",
           "write_redacted", "write_report", "write_review"]
