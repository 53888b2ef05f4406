"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.llm.common import fresh, materialize, table
from chronolith.llm.decontaminate import with_leaks
from chronolith.llm.near_dedup import keep_one
from chronolith.llm.packing import pack_documents
from chronolith.llm.secret_scan import labelled_strings, redact, train_markov, with_secret_spans
from chronolith.llm.toxicity import fit_toxicity, held_out, with_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents whose toxicity score is 0.5 or more."""
    model = fit_toxicity(docs, table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    [found] = fresh(docs.columns, "_toxicity")
    return with_toxicity(docs, model, out=found).where(F.col(f"{found}.score") < 0.5).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each class of near copies."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the documents in which a benchmark item is found."""
    [found] = fresh(docs.columns, "_leaks")
    return with_leaks(docs, table(spark, sf_dir, "benchmark"), out=found).where(F.size(found) == 0).select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret span by a mark; the other text stays."""
    base, spans = fresh(docs.columns, "_base", "_spans")
    found = with_secret_spans(docs, train_markov(labelled_strings(docs)), out=(base, spans))
    changed = F.size(spans) > 0
    found = found.withColumn("text", F.when(changed, redact(F.col("text"), F.col(spans))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents that are left into windows of 2048 tokens."""
    packed = pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL has no form of the tokenizer and the trained models; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
