"""Sources and sinks: raw message files, expectation files, and text-free audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietspan.operators.spans import SPAN

EXPECTATION = T.StructType(
    [
        T.StructField("expected_spans", T.ArrayType(T.StructType([T.StructField("detector", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("text", T.StringType())]))),
        T.StructField("expected_action", T.StringType()),
        T.StructField("must_not_appear_in_output", T.ArrayType(T.StringType())),
        T.StructField("expected_stripped", T.ArrayType(T.StringType())),
        T.StructField("expected_anomalies", T.ArrayType(T.StringType())),
        T.StructField("notes", T.StringType()),
    ]
)


def read_raw(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Whole files: path, modificationTime, length, content, stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.withColumn("stem", F.regexp_extract("path", r"([^/]+?)(?:\.expected)?\.[^./]+$", 1))


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    return read_raw(spark, path, "*.eml")


def read_calendars(spark: SparkSession, path: str) -> DataFrame:
    return read_raw(spark, path, "*.ics")


def read_expectations(spark: SparkSession, path: str) -> DataFrame:
    """Expectation files by stem, with the raw text kept for schema checks."""
    files = read_raw(spark, path, "*.expected.json").select("stem", F.decode("content", "utf-8").alias("json"))
    return files.withColumn("expected", F.from_json("json", EXPECTATION, {"mode": "PERMISSIVE"}))


def orphans(raw: DataFrame, expectations: DataFrame) -> DataFrame:
    """Raw files without an expectation."""
    return raw.join(expectations, "stem", "left_anti").select("stem")


AUDIT_COLUMNS = ("at", "account_id", "item_hash", "categories", "action", "detector_version", "policy_version")


def write_audit(decisions: DataFrame, path: str) -> None:
    """Append decisions to the audit table; the schema has no place for text, so none can leak."""
    decisions.select(*[c for c in AUDIT_COLUMNS if c in decisions.columns]).write.mode("append").parquet(path)


def write_spans(spans: DataFrame, path: str, keep_text: bool = False) -> None:
    """One row per span. The matched text is left out unless asked for."""
    rows = spans.withColumn("span", F.explode(F.col("spans").cast(f"array<{SPAN}>")))
    fields = ["span.detector", "span.start", "span.end", *(["span.text"] if keep_text else [])]
    rows.select(*[c for c in spans.columns if c != "spans"], *fields).write.mode("append").parquet(path)
