"""Background scan: a stream of items to a decision table.

The batch transformation runs on each micro-batch; items whose decision is cached already are left out,
and the rest is appended. No watermark stands on this path, as a late row that is dropped would never be
scanned. A batch that is replayed after a failure finds its own rows in the table and adds none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quietspan.operators.spans import card_spans
from quietspan.plans.policy import CACHE_KEY, Policy, cache_key, decide, misses

DECISION = T.StructType([*(T.StructField(c, T.StringType()) for c in CACHE_KEY), T.StructField("action", T.StringType()), T.StructField("categories", T.ArrayType(T.StringType()))])


def scan(items: DataFrame, policy: Policy, detector_version: str) -> DataFrame:
    """Decisions of items (text), one per content; hashes and labels only."""
    keyed = cache_key(items, policy, detector_version).dropDuplicates(CACHE_KEY)
    found = keyed.withColumn("spans", card_spans(F.coalesce("text", F.lit(""))))
    return found.select(*CACHE_KEY, decide(F.col("spans"), policy).alias("action"), F.array_distinct(F.transform("spans", lambda s: s["detector"])).alias("categories"))


def start(items: DataFrame, table: str, checkpoint: str, policy: Policy = Policy(), detector_version: str = "1", **trigger) -> StreamingQuery:  # noqa: B008
    """Append the decisions of a streaming DataFrame with a text column to the Parquet folder ``table``."""

    def batch(df: DataFrame, _: int) -> None:
        spark = df.sparkSession
        made = scan(df, policy, detector_version)
        path = spark._jvm.org.apache.hadoop.fs.Path(table)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            made = misses(made, spark.read.schema(DECISION).parquet(table))
        made.write.mode("append").parquet(table)

    return items.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def follow(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(folder)


def counts_by_window(decisions: DataFrame, at: str = "at", every: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Derived metrics only: actions by time window, late rows up to ``late``."""
    return decisions.withWatermark(at, late).groupBy(F.window(at, every), "action").agg(F.count("*").alias("n"))
