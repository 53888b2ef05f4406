"""Buckets, resampling, latest rows, replay and as-of joins. Ties in time are broken by a unique column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.schemas import interval_ms


def bucket(ts: Column, ms: int) -> Column:
    return ts - F.pmod(ts, F.lit(ms))


def _aggregate(op: str, c: str, order: Column) -> Column:
    x = F.col(c)
    ops = {"first": lambda: F.min_by(x, order), "last": lambda: F.max_by(x, order), "min": lambda: F.min(x), "max": lambda: F.max(x), "sum": lambda: F.sum(x), "count": lambda: F.count(x), "avg": lambda: F.avg(x), "mean": lambda: F.avg(x)}
    if op not in ops:
        raise ValueError(f"unknown aggregate {op!r}")
    return ops[op]()


def sample_by(df: DataFrame, every: str | int, columns: dict[str, list[str]], *, keys: list[str], ts: str = "timestamp", unique: str | None = None) -> DataFrame:
    """Aggregates of each key's time buckets; buckets without rows are left out. One pass, partial aggregation."""
    ms = every if isinstance(every, int) else interval_ms(every)
    order = F.struct(ts, unique) if unique else F.col(ts)
    aggs = [_aggregate(op, c, order).alias(c if len(ops) == 1 else f"{c}_{op}") for c, ops in columns.items() for op in ops]
    return df.groupBy(*keys, bucket(F.col(ts), ms).alias(ts)).agg(*aggs)


def ohlcv(ticks: DataFrame, every: str | int, *, keys: list[str], ts: str = "timestamp", price: str = "price", volume: str = "volume", unique: str | None = None) -> DataFrame:
    """Bars of ticks."""
    ms = every if isinstance(every, int) else interval_ms(every)
    order = F.struct(ts, unique) if unique else F.col(ts)
    p = F.col(price)
    return ticks.groupBy(*keys, bucket(F.col(ts), ms).alias(ts)).agg(
        F.min_by(p, order).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, order).alias("close"), F.sum(volume).alias("volume")
    )


def _null_safe_join(rows: DataFrame, small: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with ``value`` of the row of ``small`` that has their keys, nulls included."""
    r, o = rows.alias("r"), small.alias("o")
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys]
    return r.join(o, on, "left").select("r.*", F.col(f"o.{value}").alias(value))


def numbered(df: DataFrame, keys: list[str], order: list, name: str = "rn", *, span: int | None = None) -> DataFrame:
    """Adds each row's number in its series, from 1.

    With ``span`` (of the first order column, a time) a series is cut into buckets: rows are numbered inside them, and
    the buckets' counts, added up, are joined. So a long series is dealt over many tasks."""
    if span is None:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    rows = df.withColumn("_bucket", bucket(F.col(order[0]), span))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count("*").alias("_k"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    local = rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)).cast("long"))
    return _null_safe_join(local, offsets, [*keys, "_bucket"], "_before").withColumn(name, F.col(name) + F.col("_before")).drop("_bucket", "_before")


def bars_by_rows(df: DataFrame, n: int, *, keys: list[str], order: list[str], price: str = "price", volume: str = "volume", span: int | None = None) -> DataFrame:
    """Bars of every ``n`` consecutive ticks; the last one may be short. ``span`` as for :func:`numbered`."""
    rows = numbered(df, keys, order, span=span)
    by = F.struct("rn")
    p = F.col(price)
    return rows.groupBy(*keys, F.expr(f"(rn - 1) div {n}").alias("bar")).agg(
        F.min_by(p, by).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, by).alias("close"), F.sum(volume).alias("volume")
    )


def resample(bars: DataFrame, n: int, *, keys: list[str], ts: str = "timestamp", span: int | None = None) -> DataFrame:
    """Every ``n`` consecutive bars as one, with the first one's time; deleted bars (negative volume) are dropped."""
    rows = numbered(bars.where("volume >= 0"), keys, [ts], span=span)
    return (
        rows.groupBy(*keys, F.expr(f"(rn - 1) div {n}").alias("bar"))
        .agg(F.min(ts).alias(ts), F.min_by("open", "rn").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "rn").alias("close"), F.sum("volume").alias("volume"))
        .drop("bar")
    )


def latest_on(df: DataFrame, *, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each series, by aggregation: no sort, and map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def head_n(df: DataFrame, n: int, *, keys: list[str], order: list) -> DataFrame:
    """The first ``n`` rows of each series (a window group limit)."""
    return numbered(df, keys, order).where(F.col("rn") <= n).drop("rn")


def asof_snapshot(ticks: DataFrame, at: int, *, symbols: DataFrame | None = None, ts: str = "timestamp", unique: str = "id") -> DataFrame:
    """Latest price and volume of each symbol at a time; 0 for symbols without an earlier tick."""
    seen = ticks.where(F.col(ts) <= at).groupBy("symbol").agg(F.max_by(F.struct("price", "volume"), F.struct(ts, unique)).alias("r"))
    every = symbols if symbols is not None else ticks.select("symbol").distinct()
    return every.join(seen, "symbol", "left").select("symbol", F.coalesce("r.price", F.lit(0.0)).alias("price"), F.coalesce("r.volume", F.lit(0.0)).alias("volume"))


def asof_join(left: DataFrame, right: DataFrame, *, by: list[str], ts: str, values: list[str], right_unique: str, prefix: str = "r_", span: int | None = None) -> DataFrame:
    """Each left row with the latest right row at or before it.

    One union and one ordered window, so no row meets more than its own match; at equal times right rows come first.
    With ``span`` the window runs inside time buckets of a key, and each bucket takes the last right row of those before it."""
    kind = right.select(F.struct(*values)).schema[0].dataType
    tag = left.select("*", F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_u"), F.lit(None).cast(kind).alias("_v"))
    other = right.select(*by, ts, F.lit(0).alias("_side"), F.col(right_unique).cast("long").alias("_u"), F.struct(*values).alias("_v"))
    both = tag.unionByName(other, allowMissingColumns=True)
    parts = list(by)
    if span is not None:
        both, parts = both.withColumn("_bucket", bucket(F.col(ts), span)), [*by, "_bucket"]
    w = Window.partitionBy(*parts).orderBy(ts, "_side", "_u").rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_w", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    if span is not None:
        ends = both.groupBy(*parts).agg(F.max_by("_v", F.when(F.col("_side") == 0, F.struct(ts, "_u"))).alias("_end"))
        carried = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
        filled = _null_safe_join(filled, carried.select(*parts, "_carried"), parts, "_carried").withColumn("_w", F.coalesce("_w", "_carried"))
    return filled.select(*left.columns, *[F.col(f"_w.{v}").alias(prefix + v) for v in values])


def nearest_time(df: DataFrame, at: int, *, keys: list[str], ts: str = "timestamp", unique: str = "id") -> DataFrame:
    """The row of each series nearest in time; of two equally near the later."""
    rest = [c for c in df.columns if c not in keys]
    near = F.struct(F.abs(F.col(ts) - at), -F.col(ts), F.col(unique))
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), near).alias("r")).select(*keys, "r.*")


def replay_ticks(ticks: DataFrame, *, ts: str = "timestamp", unique: str = "id") -> DataFrame:
    """All series' ticks in one order of time."""
    return ticks.orderBy(ts, "symbol", unique)


def snapshot_boundaries(df: DataFrame, *, ts: str = "timestamp") -> DataFrame:
    """The times at which a snapshot begins: each distinct time once."""
    return df.groupBy(ts).agg(F.count("*").alias("n"))


def replay_changes(ticks: DataFrame, *, start: int | None = None, ts: str = "timestamp", unique: str = "id") -> DataFrame:
    """Sparse replay: at each time, the symbols that changed and their latest values; state warms up before ``start``."""
    last = ticks.groupBy(ts, "symbol").agg(F.max_by(F.struct("price", "volume"), unique).alias("r"), F.count("*").alias("ticks"))
    out = last.select(ts, "symbol", "r.price", "r.volume", "ticks")
    return out if start is None else out.where(F.col(ts) >= start)


def replay_dense(ticks: DataFrame, every: str | int, symbols: list[str], *, ts: str = "timestamp", unique: str = "id") -> DataFrame:
    """Dense replay on a clock: every symbol's latest values at each bucket that has ticks of any symbol.

    The grid is buckets times the symbols asked for, so the bucket bounds it."""
    ms = every if isinstance(every, int) else interval_ms(every)
    b = ticks.withColumn("_b", bucket(F.col(ts), ms))
    have = b.groupBy("_b", "symbol").agg(F.max_by(F.struct("price", "volume"), F.struct(ts, unique)).alias("r"))
    grid = b.select("_b").distinct().select("_b", F.explode(F.array(*map(F.lit, symbols))).alias("symbol"))
    w = Window.partitionBy("symbol").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    filled = grid.join(have, ["_b", "symbol"], "left").withColumn("r", F.last("r", ignorenulls=True).over(w))
    return filled.select(F.col("_b").alias(ts), "symbol", F.coalesce("r.price", F.lit(0.0)).alias("price"), F.coalesce("r.volume", F.lit(0.0)).alias("volume"))


def prefix_sum(df: DataFrame, value: str, *, keys: list[str], order: list[str], span: int | None = None) -> DataFrame:
    """Adds the running sum; with ``span`` in time buckets, whose sums are added up apart (see :func:`numbered`)."""
    if span is None:
        return df.withColumn("prefix_sum", F.sum(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    rows = df.withColumn("_bucket", bucket(F.col(order[0]), span))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys, "_bucket").agg(F.sum(value).alias("_k")).withColumn("_before", F.coalesce(F.sum("_k").over(before), F.lit(0))).drop("_k")
    local = rows.withColumn("prefix_sum", F.sum(value).over(Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    return _null_safe_join(local, sums, [*keys, "_bucket"], "_before").withColumn("prefix_sum", F.coalesce("prefix_sum", F.lit(0)) + F.col("_before")).drop("_bucket", "_before")


def delta_encode(df: DataFrame, value: str, *, keys: list[str], order: list[str]) -> DataFrame:
    """Differences to the row before; the first value as it is."""
    x = F.col(value)
    return df.withColumn("delta", F.coalesce(x - F.lag(x).over(Window.partitionBy(*keys).orderBy(*order)), x))


def delta_decode(df: DataFrame, value: str, *, keys: list[str], order: list[str], span: int | None = None) -> DataFrame:
    """Undoes :func:`delta_encode`: the running sum of the differences."""
    return prefix_sum(df, value, keys=keys, order=order, span=span).withColumnRenamed("prefix_sum", "decoded")


def first_rows(df: DataFrame, keys: list[str], order: list[str], columns: list[str], **aggregates: Column) -> DataFrame:
    """Groups with aggregates, and the first row's value (by ``order``) of columns that are neither keys nor aggregated."""
    return df.groupBy(*keys).agg(*[F.min_by(c, F.struct(*order)).alias(c) for c in columns], *[x.alias(n) for n, x in aggregates.items()])


def first_index_at_or_after(df: DataFrame, targets: DataFrame, *, keys: list[str], ts: str = "timestamp", target: str = "target") -> DataFrame:
    """For each target, how many rows of its series lie before it (a lower bound), by one union and window."""
    rows = df.select(*keys, F.col(ts).alias("_t"), F.lit(1).alias("_n"), F.lit(None).cast("long").alias(target))
    asks = targets.select(*keys, F.col(target).alias("_t"), F.lit(0).alias("_n"), target)
    w = Window.partitionBy(*keys).orderBy("_t", "_n").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(asks).withColumn("index", F.sum("_n").over(w))
    return both.where("_n = 0").select(*keys, target, "index")
