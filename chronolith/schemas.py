"""Schemas of bars, ticks, vectors and facts, and the lengths of named intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BAR = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("interval", T.StringType()), T.StructField("timestamp", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume")]
)
TICK = T.StructType([T.StructField("timestamp", T.LongType()), T.StructField("symbol", T.StringType()), T.StructField("price", T.DoubleType()), T.StructField("volume", T.DoubleType())])
VECTOR = T.StructType(
    [T.StructField("timestamp", T.LongType()), T.StructField("agent_id", T.StringType()), T.StructField("type", T.StringType()), T.StructField("confidence", T.FloatType()), T.StructField("embedding", T.ArrayType(T.FloatType()))]
)
FACT = T.StructType([*VECTOR.fields, *[T.StructField(c, T.StringType()) for c in ("text", "key", "scope", "validity")]])

_MINUTE = 60_000
#: Milliseconds of a named interval; a month counts as 30 days.
INTERVAL_MS = {f"{n}m": n * _MINUTE for n in (1, 3, 5, 15, 30)} | {f"{n}h": n * 60 * _MINUTE for n in (1, 2, 4, 6, 8, 12)} | {"1d": 1440 * _MINUTE, "3d": 4320 * _MINUTE, "1w": 10080 * _MINUTE, "1M": 43200 * _MINUTE}
_UNIT_MS = {"s": 1000, "m": _MINUTE, "h": 60 * _MINUTE, "d": 1440 * _MINUTE}


def interval_ms(name: str) -> int:
    """Milliseconds of ``5m``, ``1h`` and the like."""
    if name in INTERVAL_MS:
        return INTERVAL_MS[name]
    number, unit = name[:-1], name[-1:]
    if not number.isdigit() or unit not in _UNIT_MS:
        raise ValueError(f"not an interval: {name!r}")
    return int(number) * _UNIT_MS[unit]


def canonical_interval(c: Column) -> Column:
    """Minute counts as interval names: 60 is 1h, 240 is 4h, 1440 is 1d, other numbers n are nm; names stay."""
    named = F.when(c == "60", "1h").when(c == "240", "4h").when(c == "1440", "1d")
    return named.when(c.rlike(r"^\d+$"), F.concat(c, F.lit("m"))).otherwise(c)


def bars_count(span_ms: Column, interval: str) -> Column:
    return F.ceil(span_ms / F.lit(interval_ms(interval)))


def fill_defaults(df: DataFrame) -> DataFrame:
    """Nulls as 0 and empty text, for stores that cannot hold nulls."""
    return df.fillna(0).fillna("")


def missing_columns(df: DataFrame, schema: T.StructType = BAR) -> list[str]:
    return [c for c in schema.names if c not in df.columns]


_ALIASES = {"timestamp": ["ts", "time", "datetime"], "open": ["o"], "high": ["h"], "low": ["l"], "close": ["c"], "volume": ["vol", "v", "amount"]}


def canonical_columns(df: DataFrame) -> DataFrame:
    """Renames the usual short column names to the canonical ones."""
    for name, others in _ALIASES.items():
        found = [c for c in df.columns if c.lower() in others]
        if name not in df.columns and found:
            df = df.withColumnRenamed(found[0], name)
    return df
