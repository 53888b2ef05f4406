"""Checks of bar series: repeated and unordered times, gaps, price bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def duplicate_times(df: DataFrame, keys: list[str], ts: str = "timestamp") -> DataFrame:
    """Repeats beyond the first, of each series that has some; no distinct sort, two partial aggregations."""
    per = df.groupBy(*keys, ts).agg(F.count("*").alias("n"))
    return per.groupBy(*keys).agg(F.sum(F.col("n") - 1).alias("duplicates")).where("duplicates > 0")


def out_of_order(df: DataFrame, keys: list[str], order: str, ts: str = "timestamp") -> DataFrame:
    """Rows whose time does not lie after the one before them in arrival order."""
    before = F.lag(ts).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("previous", before).where(F.col(ts) <= F.col("previous"))


def gaps(df: DataFrame, keys: list[str], step: int | None = None, ts: str = "timestamp") -> DataFrame:
    """Places where the next time is another one than a step later; the step is the series' first difference if none is given."""
    if step is None:
        w = Window.partitionBy(*keys).orderBy(ts)
        found = df.select(*keys, F.col(ts).alias("gap_from"), F.lead(ts).over(w).alias("gap_to"), F.row_number().over(w).alias("_n"))
        step_of = F.max(F.when(F.col("_n") == 1, F.col("gap_to") - F.col("gap_from"))).over(Window.partitionBy(*keys))
        return found.withColumn("step", step_of).where(F.col("gap_to") - F.col("gap_from") != F.col("step")).drop("_n")
    after = F.lead(ts).over(Window.partitionBy(*keys).orderBy(ts))
    found = df.select(*keys, F.col(ts).alias("gap_from"), after.alias("gap_to"))
    return found.where(F.col("gap_to") - F.col("gap_from") != step).withColumn("missing", F.expr(f"(gap_to - gap_from) div {step} - 1"))


def price_violations(bars: DataFrame, keys: list[str], ts: str = "timestamp") -> DataFrame:
    """One row for each rule that a bar breaks."""
    o, h, lo, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    rules = {
        "high_below_prices": h < F.greatest(o, c, lo),
        "low_above_prices": lo > F.least(o, c, h),
        "high_below_low": h < lo,
        "negative_volume": v < 0,
        "price_not_positive": F.least(o, h, lo, c) <= 0,
    }
    names = F.filter(F.array(*[F.when(x, F.lit(n)) for n, x in rules.items()]), lambda x: x.isNotNull())
    return bars.select(*keys, ts, F.explode(names).alias("violation"))


def valid_bars(bars: DataFrame) -> DataFrame:
    """The bars whose numbers are all finite and whose prices lie within low and high."""
    finite = F.lit(True)
    for c in ("open", "high", "low", "close", "volume"):
        x = F.col(c)
        finite = finite & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    inside = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close", "high")) & (F.col("volume") >= 0)
    return bars.where(finite & inside)
