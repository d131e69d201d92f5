"""Row-wise Arrow helpers shared by the operators."""

from __future__ import annotations

import ctypes
import gc
import os
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

TEXT = "__qs_text"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Return what a task freed to the system: a reused Python worker would hold it through stages that need none of it."""
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def append_columns(
    df: DataFrame,
    text_col: str,
    fields: T.StructType,
    make: Callable[[], Callable[[list, pa.RecordBatch], list[list]]],
    binary: bool = True,
    text_too: bool = True,
) -> DataFrame:
    """All columns of ``df`` plus ``fields``, computed batch by batch from ``text_col``.

    ``make()`` runs once per Python task and returns a function of (texts, batch) that gives one
    list per field. Texts arrive as UTF-8 bytes (``binary``) or str; null stays None. A column of
    ``df`` whose name (letter case ignored) equals a result column is replaced. No shuffle. A string
    column is handed over once, also where it stays; without ``text_too`` it does not come back.
    """
    new = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in new and (text_too or c != text_col)]
    there = text_col in keep and df.schema[text_col].dataType == T.StringType()
    at = keep.index(text_col) if there else len(keep)
    src = df.select(*[df[f"`{c}`"] for c in keep], *([] if there else [df[f"`{text_col}`"].cast("string").alias(TEXT)]))
    kept = len(keep)
    schema = T.StructType([*src.schema.fields[:kept], *fields.fields])
    out_types = list(to_arrow_schema(fields))
    names = [f.name for f in schema.fields]

    def run(batches):
        fn = make()
        for batch in batches:
            col = batch.column(at)
            if binary:
                col = col.cast(pa.large_binary() if pa.types.is_large_string(col.type) else pa.binary())
            made = fn(col.to_pylist(), batch)
            cols = [*batch.columns[:kept], *(x if isinstance(x, pa.Array) else pa.array(x, t.type) for x, t in zip(made, out_types, strict=True))]
            yield pa.RecordBatch.from_arrays(cols, names=names)
        del fn
        give_back()

    return src.mapInArrow(run, schema)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and runs on one machine a folder below the warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = os.path.join(spark.conf.get("spark.sql.warehouse.dir"), "qs_checkpoints")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_shared(df: DataFrame, path: str) -> None:
    """``df`` as Parquet. What the job shuffled is removed when it ends, as nothing reads it again."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends there, and a lost executor costs nothing that was written."""
    path = shared_dir(df.sparkSession, name)
    write_shared(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for t in tables:
        session = t.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = session._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def nonnull_text(df: DataFrame, col: str = "text") -> F.Column:
    return F.coalesce(df[col], F.lit(""))
