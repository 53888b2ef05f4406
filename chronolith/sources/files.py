"""File sources and sinks: explicit schemas, bad lines counted, day partitions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolith.schemas import BAR, VECTOR

_BAD = "_corrupt"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ingest_csv(spark: SparkSession, path: str, schema: T.StructType = BAR) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of CSV files; a line that is just the columns' names, in their order, is a header and skipped."""
    names = F.translate(F.lower("value"), " \t\"\r", "")
    lines = spark.read.text(path).where((names != ",".join(schema.names).lower()) & (F.trim("value") != ""))
    full = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    parsed = lines.select("value", F.from_csv("value", full.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD}).alias("r"))
    bad = F.col(f"r.{_BAD}").isNotNull() | F.col(f"r.{schema.names[0]}").isNull()
    return parsed.where(~bad).select(*[f"r.{c}" for c in schema.names]), parsed.where(bad).select("value")


def ingest_jsonl(spark: SparkSession, path: str, schema: T.StructType = BAR, required: tuple[str, ...] = ("symbol", "interval", "timestamp")) -> tuple[DataFrame, DataFrame]:
    """(rows, bad lines) of JSON lines in any key order; lines without a required key are bad."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema).alias("r"))
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(f"r.{c}").isNull()
    return parsed.where(~bad).select("r.*"), parsed.where(bad).select("value")


def ingest_vectors(spark: SparkSession, path: str, *, symbol: str = "bot-006", interval: str = "semantic") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(bars, vectors, bad lines) of JSON lines: a line with an ``embedding`` is a vector, whatever the order of its keys.

    Vectors without symbol or interval take the given ones."""
    fields = {f.name: f for f in [*BAR.fields, *VECTOR.fields]}
    lines = spark.read.text(path).where(F.trim("value") != "")
    r = lines.select("value", F.from_json("value", T.StructType(list(fields.values()))).alias("r")).select("value", "r.*")
    vector = F.col("embedding").isNotNull()
    good = F.col("timestamp").isNotNull() & (vector | (F.col("symbol").isNotNull() & F.col("interval").isNotNull()))
    named = {"symbol": F.coalesce("symbol", F.lit(symbol)), "interval": F.coalesce("interval", F.lit(interval))}
    vectors = r.where(good & vector).withColumns(named).select("symbol", "interval", *VECTOR.names)
    return r.where(good & ~vector).select(*BAR.names), vectors, r.where(~F.coalesce(good, F.lit(False))).select("value")


def read_days(spark: SparkSession, path: str, *, start: int | None = None, end: int | None = None, ts: str = "timestamp") -> DataFrame:
    """Day partitions of a closed time range: whole days are pruned by their folder, rows by their time."""
    df = spark.read.option("basePath", path).parquet(path)
    day = lambda ms: F.date_format(F.timestamp_millis(F.lit(ms)), "yyyy-MM-dd")
    if start is not None and start >= 0:
        df = df.where((F.col("day").cast("string") >= day(start)) & (F.col(ts) >= start))
    if end is not None and end >= 0:
        df = df.where((F.col("day").cast("string") <= day(end)) & (F.col(ts) <= end))
    return df


def copy_series(source: DataFrame, path: str, *, symbols: list[str] | None = None, ts: str = "timestamp") -> None:
    """Migrates a store's series to day partitions under another path."""
    write_by_day(source if symbols is None else source.where(F.col("symbol").isin(symbols) if symbols else F.lit(False)), path, ts)


def write_by_day(bars: DataFrame, path: str, ts: str = "timestamp", mode: str = "append") -> None:
    """Day partitions in UTC, sorted by time inside each file, so that scans prune by day and by row group.

    Rows are dealt by ranges of day, symbol and time, so that a large day goes to several tasks."""
    day = F.date_format(F.timestamp_millis(F.col(ts)), "yyyy-MM-dd")
    bars.withColumn("day", day).repartitionByRange("day", "symbol", ts).sortWithinPartitions("day", "symbol", ts).write.mode(mode).partitionBy("day").parquet(path)


def write_tiers(bars: DataFrame, hot: str, cold: str, cutoff_ms: int, ts: str = "timestamp") -> None:
    """Rows from the cutoff on to the hot path, older ones to the cold path."""
    write_by_day(bars.where(F.col(ts) >= cutoff_ms), hot, ts)
    write_by_day(bars.where(F.col(ts) < cutoff_ms), cold, ts)


def merged_tiers(spark: SparkSession, hot: str, cold: str) -> DataFrame:
    return spark.read.parquet(hot).unionByName(spark.read.parquet(cold))


def export(bars: DataFrame, path: str, fmt: str = "json", mode: str = "error") -> None:
    """JSON lines or CSV without deleted rows (negative volume); numbers in CSV have eight decimals."""
    rows = bars.where(F.col("volume") >= 0)
    if fmt == "csv":
        rows = rows.select([F.format_string("%.8f", c).alias(c) if k == "double" else F.col(c) for c, k in rows.dtypes])
    writer = rows.write.mode(mode)
    writer.csv(path, header=True) if fmt == "csv" else writer.json(path)


def synthetic_bars(spark: SparkSession, symbols: list[str], n: int, *, seed: int = 7, start: int = 1_700_000_000_000, step: int = 60_000, price: float = 100.0, volatility: float = 0.01, gap: float = 0.02) -> DataFrame:
    """Seeded random bars for tests: a geometric walk, now and then a gap. Every bar follows from its number and the seed."""
    name = F.explode(F.array(*map(F.lit, symbols))).alias("symbol")
    rows = spark.range(n).select(F.col("id").alias("i"), name)
    u = lambda k: (F.pmod(F.xxhash64("symbol", "i", F.lit(seed), F.lit(k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    normal = F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * math.pi * u(2))
    move = F.lit(volatility) * normal + F.when(u(3) < gap, F.lit(5 * volatility) * F.signum(u(4) - 0.5)).otherwise(0.0)
    by = Window.partitionBy("symbol").orderBy("i")
    t = rows.withColumn("move", move).withColumn("close", F.lit(price) * F.exp(F.sum("move").over(by.rowsBetween(Window.unboundedPreceding, 0))))
    t = t.withColumn("open", F.coalesce(F.lag("close").over(by), F.lit(price)))
    t = t.withColumn("high", F.greatest("open", "close") * (1 + F.lit(volatility) * u(5))).withColumn("low", F.least("open", "close") * (1 - F.lit(volatility) * u(6)))
    return t.select("symbol", F.lit("1m").alias("interval"), (F.lit(start) + F.col("i") * step).alias("timestamp"), "open", "high", "low", "close", (1000 * u(7)).alias("volume"))
