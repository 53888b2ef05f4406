"""Scans of series by symbol, interval and time; predicates reach the Parquet reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def scan(df: DataFrame, *, symbols: list[str] | None = None, interval: str | None = None, start: int | None = None, end: int | None = None, limit: int | None = None, newest_first: bool = False, ts: str = "timestamp") -> DataFrame:
    """Rows of the symbols (none given: all; an empty list: none) in the closed time range."""
    if symbols is not None:
        df = df.where(F.col("symbol").isin(symbols) if symbols else F.lit(False))
    if interval is not None:
        df = df.where(F.col("interval") == interval)
    if start is not None and start >= 0:
        df = df.where(F.col(ts) >= start)
    if end is not None and end >= 0:
        df = df.where(F.col(ts) <= end)
    if newest_first:
        df = df.orderBy(F.desc(ts))
    return df if limit is None else df.limit(limit)


def list_series(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys).distinct()


def latest_timestamp(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """The latest time, -1 for no rows."""
    return df.agg(F.coalesce(F.max(ts), F.lit(-1)).alias("latest"))


def tuple_in(df: DataFrame, columns: list[str], tuples: list[tuple]) -> DataFrame:
    """Rows whose columns are one of the tuples; the literals take the columns' types."""
    kinds = [df.schema[c].dataType for c in columns]
    wanted = [F.struct(*[F.lit(v).cast(k) for v, k in zip(t, kinds)]) for t in tuples]
    return df.where(F.struct(*columns).isin(*wanted)) if wanted else df.where(F.lit(False))


def symbol_stats(bars: DataFrame, keys: list[str]) -> DataFrame:
    return bars.groupBy(*keys).agg(
        F.count("*").alias("count"), F.min("timestamp").alias("earliest"), F.max("timestamp").alias("latest"), F.avg("close").alias("avg_price"), F.min("low").alias("min_price"), F.max("high").alias("max_price")
    )


def table_info(bars: DataFrame) -> DataFrame:
    """Total rows, and those not deleted (volume not negative)."""
    dead = F.count_if(F.col("volume") < 0)
    return bars.agg(F.count("*").alias("total_rows"), (F.count("*") - dead).alias("valid_rows"), dead.alias("tombstones"))


def slice_rows(df: DataFrame, start: int, end: int, *, keys: list[str], order: list[str]) -> DataFrame:
    """Rows start to end (exclusive, from 0) of each series."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_n", n).where((F.col("_n") > start) & (F.col("_n") <= end)).drop("_n")
