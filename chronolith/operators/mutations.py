"""Upserts, deletes, merges and deleted-row resolution, as rewrites of immutable tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_wins(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row for each key of an append-only log, the last written; aggregation combines map-side."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*[k for k in keys], *[f"r.{c}" for c in rest]).select(*log.columns)


def resolve_tombstones(log: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The live rows of a log: the last of each key, unless it is a deletion (negative volume)."""
    return latest_wins(log, keys, seq).where("volume >= 0")


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], update: list[str] | None = None, *, seq: str | None = None) -> DataFrame:
    """Inserts the changes; rows whose key exists take the ``update`` columns (all others: every column). Of changes with
    the same key the last one wins: by the column ``seq``, or without one by the changes' order of rows."""
    order = seq or "_seq"
    changes = latest_wins(changes if seq else changes.withColumn("_seq", F.monotonically_increasing_id()), keys, order).select(*base.columns)
    update = [c for c in base.columns if c not in keys] if update is None else update
    b, c = base.alias("b"), changes.alias("c")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys]
    joined = b.withColumn("_old", F.lit(1)).alias("b").join(c.withColumn("_new", F.lit(1)).alias("c"), on, "full_outer")
    old, new = F.col("b._old").isNotNull(), F.col("c._new").isNotNull()
    pick = lambda x: F.when(new & (~old | F.lit(x in update)), F.col(f"c.{x}")).otherwise(F.col(f"b.{x}")).alias(x)
    return joined.select(*[F.coalesce(F.col(f"b.{x}"), F.col(f"c.{x}")).alias(x) if x in keys else pick(x) for x in base.columns])


def delete_keys(base: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(doomed.select(*keys).distinct(), keys, "left_anti")


def delete_where(base: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition is not true."""
    return base.where(~F.coalesce(condition, F.lit(False)))


def update_where(base: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    hit = F.coalesce(condition, F.lit(False))
    return base.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def update_row(base: DataFrame, number: int, values: dict[str, Column], *, order: list[str]) -> DataFrame:
    """Changes one row, given by its number (from 0) in the order of unique columns."""
    ids = base.orderBy(*order).offset(number).limit(1).select(*order)  # one row
    return base.join(F.broadcast(ids.withColumn("_hit", F.lit(True))), order, "left").withColumns({c: F.when(F.col("_hit"), v).otherwise(F.col(c)) for c, v in values.items()}).select(*base.columns)


def compact(log: DataFrame, path: str, keys: list[str], seq: str, *, partition: str | None = None) -> DataFrame:
    """Rewrites a log without deleted and overwritten rows to a new path, and reads it back."""
    live = resolve_tombstones(log, keys, seq)
    writer = live.write.partitionBy(partition) if partition else live.write
    writer.parquet(path)
    return log.sparkSession.read.schema(log.schema).parquet(path)


def merge_absent(source: DataFrame, target: DataFrame, keys: list[str], *, symbols: list[str] | None = None, interval: str | None = None) -> DataFrame:
    """The target and the source's live rows (of some symbols and one interval, if given) whose key it lacks, each key once."""
    live = source.where("volume >= 0") if "volume" in source.columns else source
    if symbols is not None:
        live = live.where(F.col("symbol").isin(symbols) if symbols else F.lit(False))
    if interval is not None:
        live = live.where(F.col("interval") == interval)
    return target.unionByName(live.join(target.select(*keys), keys, "left_anti").dropDuplicates(keys))


def clear_series(base: DataFrame, **key: str) -> DataFrame:
    condition = F.lit(True)
    for c, v in key.items():
        condition = condition & (F.col(c) == v)
    return delete_where(base, condition)
