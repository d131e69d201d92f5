"""The corpus pipeline: STAGES over the documents table, each written as Parquet and read again.

toxicity: rejects toxic documents. neardup: keeps one document of each near-duplicate class (the least
id). decontaminate: drops documents that hold a benchmark passage. secrets: masks secrets in the texts
(n_chars follows). bpe: token ids of what is left. ORACLE_SQL is None: the stages hold a fitted model, a
sketch and a dynamic program, which SQL does not express; tests/llm compares run() with a brute-force
version.

Defined results: rows with a null text are neither toxic nor contaminated, stand alone in their class and
have no ids; wholly repeated rows are one; empty tables give empty ones; further columns pass through
whatever their names are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietspan.llm import bpe, decontaminate, neardup, secrets, toxicity
from quietspan.llm.rows import discard, materialise, table


def _apart(docs: DataFrame) -> DataFrame:
    """The id and text for an operator, and the rest of the row beside them: no column of a document can clash with a result, and a text is there once."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("__doc"))


def _rows(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*[F.col("text") if c == "text" else F.col(f"__doc.`{c}`") for c in docs.columns])


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _rows(toxicity.score(_apart(docs), model).where("not toxic"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _rows(neardup.classes(_apart(docs)).where("stays"), docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(_apart(docs), table(spark, sf_dir, "benchmark"))
    return _rows(found.where("not contaminated"), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    masked = secrets.redact(docs, vocabulary_path=public_tokenizers.path("word_bpe_49k.json"))
    if "n_chars" in docs.columns:
        masked = masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return masked.select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN, keep_ids=True, digests=True, text_too=False)
    return out.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("neardup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = table(spark, sf_dir, "documents"), False
    for name, stage in STAGES:
        made = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if written:
            discard(docs)
        docs, written = made, True
    return docs
