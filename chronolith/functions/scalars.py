"""Scalar functions whose results differ from Spark's own of the same name."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKENS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss"}


def round_half_up(x: Column, digits: int = 0) -> Column:
    """Halves go up: floor(x * 10^n + 0.5) / 10^n."""
    f = F.lit(float(10**digits))
    return F.floor(x * f + F.lit(0.5)) / f


def strftime(ms: Column, pattern: str) -> Column:
    """A UTC time in milliseconds (or seconds, where the number is below 1e12) as text."""
    java, i = "", 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in _TOKENS:
            java, i = java + _TOKENS[two], i + 2
        else:
            java, i = java + (f"'{pattern[i]}'" if pattern[i].isalpha() else pattern[i]), i + 1
    return F.date_format(F.timestamp_millis(F.when(ms < 10**12, ms * 1000).otherwise(ms).cast("long")), java)


def null_concat(*parts: Column) -> Column:
    """Concatenation in which null is empty."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def safe_divide(a: Column, b: Column) -> Column:
    return a / F.nullif(b, F.lit(0))


def sample_std(x: Column) -> Column:
    """Sample deviation; 0 for fewer than two values."""
    return F.coalesce(F.stddev_samp(x), F.lit(0.0))


def sample_var(x: Column) -> Column:
    return F.coalesce(F.var_samp(x), F.lit(0.0))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 where a norm is 0 or the lengths differ."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), _dot(a, b) / norm).otherwise(0.0)


def cosine_to(a: Column, vector: list[float]) -> Column:
    """Cosine similarity to a fixed vector, whose norm is taken once."""
    other = math.sqrt(sum(float(x) ** 2 for x in vector))
    norm = F.sqrt(_dot(a, a)) * F.lit(other)
    return F.when((F.size(a) == len(vector)) & (norm > 0), _dot(a, F.array(*[F.lit(float(x)) for x in vector])) / norm).otherwise(0.0)


def hash_bucket(x: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(x), F.lit(n))


def asset_class(symbol: Column) -> Column:
    """A coarse class of a market symbol by its form."""
    return (
        F.when(symbol.rlike(r"(?i)(usdt|usdc|btc|eth)$"), "crypto")
        .when(symbol.rlike(r"^\d{6}(\.(sh|sz|SH|SZ))?$"), "stock_cn")
        .when(symbol.rlike(r"^\d{4,5}\.(hk|HK)$"), "stock_hk")
        .when(symbol.rlike(r"^[A-Z]{6}$"), "forex")
        .when(symbol.rlike(r"^[A-Z.]{1,5}$"), "stock_us")
        .otherwise("other")
    )
