"""A small store of facts: texts with embeddings, searched by text or vector, aged, deduplicated and archived."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.operators import vectors as vec
from chronolith.schemas import FACT


def write_facts(facts: DataFrame, dim: int = 64, text: str = "text") -> DataFrame:
    """Facts with embeddings of their texts, ready to be appended."""
    return facts.withColumn("embedding", vec.hash_embedding(F.col(text), dim))


def import_jsonl(spark, path: str, dim: int = 64) -> tuple[DataFrame, DataFrame]:
    """(facts, bad lines) of JSON lines; lines need a time and a text or an embedding. Missing embeddings are made of the text."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", FACT).alias("r"))
    good = F.col("r.timestamp").isNotNull() & (F.col("r.text").isNotNull() | F.col("r.embedding").isNotNull())
    rows = parsed.where(good).select("r.*")
    made = F.when(F.col("text").isNotNull(), vec.hash_embedding(F.coalesce("text", F.lit("")), dim))
    return rows.withColumn("embedding", F.coalesce(F.col("embedding").cast("array<double>"), made)), parsed.where(~good).select("value")


def list_facts(facts: DataFrame, *, scope: str | None = None, agent: str | None = None, kind: str | None = None, limit: int = 50, ts: str = "timestamp", unique: str = "fact_id") -> DataFrame:
    """The newest facts of a scope, an agent and a type, newest first."""
    for column, wanted in (("scope", scope), ("agent_id", agent), ("type", kind)):
        if wanted is not None:
            facts = facts.where(F.col(column) == wanted)
    return facts.orderBy(F.desc(ts), F.desc(unique)).limit(limit)


#: Milliseconds of a duration's unit; a month has 30 days.
UNITS = {"mo": 30 * 86_400_000, "d": 86_400_000, "h": 3_600_000, "m": 60_000, "s": 1000, "": 1}


def duration_ms(text: str) -> int:
    """Milliseconds of ``7d``, ``24h``, ``1.5mo``, ``3600s`` or a bare number of milliseconds."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d*)?|\.\d+)\s*([a-z]*)\s*", text.lower())
    if not m or m[2] not in UNITS:
        raise ValueError(f"not a duration: {text!r}")
    return int(float(m[1]) * UNITS[m[2]])


def embed_text(spark, text: str, dim: int = 64) -> list[float]:
    """One text's embedding, by the same function as the table's."""
    return list(spark.createDataFrame([(text,)], "t string").select(vec.hash_embedding(F.col("t"), dim)).first()[0])


def search(facts: DataFrame, query: str | list[float], k: int = 5, *, scope: str | None = None, agent: str | None = None, threshold: float = 0.0, dim: int = 64, unique: str = "fact_id") -> DataFrame:
    """The k most similar facts of a scope and an agent."""
    q = embed_text(facts.sparkSession, query, dim) if isinstance(query, str) else query
    rows = facts if scope is None else facts.where(F.col("scope") == scope)
    rows = rows if agent is None else rows.where(F.col("agent_id") == agent)
    return vec.knn(rows, q, k, threshold=threshold, unique=unique)


def search_with_decay(facts: DataFrame, query: str | list[float], k: int, *, now: int, half_life: str | int, dim: int = 64, ts: str = "timestamp", unique: str = "fact_id") -> DataFrame:
    """The k facts with the highest similarity after ageing; the half-life as ``7d`` or in milliseconds."""
    half_life_ms = duration_ms(half_life) if isinstance(half_life, str) else half_life
    q = embed_text(facts.sparkSession, query, dim) if isinstance(query, str) else query
    scored = facts.where(F.size("embedding") == len(q)).withColumn("score", vec.decay(vec.cosine_to(F.col("embedding"), q), F.lit(now) - F.col(ts), half_life_ms))
    return scored.orderBy(F.desc("score"), unique).limit(k)


def deduplicate(facts: DataFrame, threshold: float = 0.95, *, unique: str = "fact_id") -> DataFrame:
    """Facts without those that are similar to one with a smaller id."""
    return facts.join(vec.similar_to_earlier(facts, threshold, unique=unique), unique, "left_anti")


def archive(facts: DataFrame, cutoff: int, *, ts: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """(kept, archived) facts by a cutoff of time; rows without a time are kept."""
    old = F.coalesce(F.col(ts) < cutoff, F.lit(False))
    return facts.where(~old), facts.where(old)
