"""Trading analytics: statistics, equity, drawdown, positions, reports and limits."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def trade_stats(trades: DataFrame, keys: list[str], pnl: str = "pnl") -> DataFrame:
    win = F.count_if(F.col(pnl) > 0)
    return trades.groupBy(*keys).agg(
        F.count("*").alias("trades"), win.alias("wins"), F.count_if(F.col(pnl) < 0).alias("losses"), F.sum(pnl).alias("total_pnl"), F.avg(pnl).alias("avg_pnl"), (win * 100.0 / F.count("*")).alias("win_rate")
    )


def equity_curve(trades: DataFrame, keys: list[str], order: list[str], pnl: str = "pnl", initial: float = 0.0) -> DataFrame:
    """Adds ``equity``, its running ``peak`` (at least the start) and ``drawdown``."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("equity", F.lit(initial) + F.sum(pnl).over(w))
    t = t.withColumn("peak", F.greatest(F.lit(initial), F.max("equity").over(w)))
    return t.withColumn("drawdown", F.col("peak") - F.col("equity"))


def max_drawdown(trades: DataFrame, keys: list[str], order: list[str], pnl: str = "pnl", initial: float = 0.0) -> DataFrame:
    return equity_curve(trades, keys, order, pnl, initial).groupBy(*keys).agg(F.max("drawdown").alias("max_drawdown"))


def sharpe(returns: Column) -> Column:
    """Mean over population deviation; 0 for fewer than two values or no spread."""
    return F.when(F.count(returns) < 2, 0.0).otherwise(F.coalesce(F.avg(returns) / F.nullif(F.stddev_pop(returns), F.lit(0.0)), F.lit(0.0)))


def backtest_result(trades: DataFrame, keys: list[str], order: list[str], ts: str, *, initial: float, pnl: str = "pnl") -> DataFrame:
    """Returns, win rate, average win and loss, profit factor, drawdown as a share of the peak, and Sharpe ratio."""
    curve = equity_curve(trades, keys, order, pnl, initial)
    before = F.lag("equity", 1).over(Window.partitionBy(*keys).orderBy(*order))
    curve = curve.withColumn("_r", F.coalesce(F.col("equity") / F.nullif(before, F.lit(0.0)) - 1, F.lit(0.0)))
    p = F.col(pnl)
    won, lost = F.sum(F.when(p > 0, p)), -F.sum(F.when(p < 0, p))
    total = F.sum(p) / initial
    days = F.greatest((F.max(ts) - F.min(ts)) / 86_400_000.0, F.lit(1.0))
    return curve.groupBy(*keys).agg(
        total.alias("total_return"), (total * 365 / days).alias("annual_return"), (F.count_if(p > 0) * 100.0 / F.count("*")).alias("win_rate"), F.avg(F.when(p > 0, p)).alias("avg_win"), F.avg(F.when(p < 0, p)).alias("avg_loss"),
        (won / F.nullif(lost, F.lit(0.0))).alias("profit_factor"), F.max(F.col("drawdown") / F.nullif(F.col("peak"), F.lit(0.0))).alias("max_drawdown"), sharpe(F.col("_r")).alias("sharpe"),
    )


def positions(fills: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Average-cost accounting of fills (side, price, qty): position, average price and realised profit after each.

    Each fill depends on all before it, so a key's fills go through one task in order. A task's keys stream through one
    function in batches of Arrow's size: neither a key's fills nor a frame for each key is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos = avg = 0.0
        for b in batches:
            out = []
            plain = lambda c: b.column(c).to_numpy(zero_copy_only=False).tolist()
            for first, side, price, qty in zip(plain("_first"), plain("side"), plain("price"), plain("qty")):
                if first:
                    pos = avg = 0.0
                q = qty if side == "buy" else -qty
                gain = 0.0
                if pos * q >= 0:
                    avg = (avg * abs(pos) + price * abs(q)) / (abs(pos) + abs(q)) if q else avg
                else:
                    closed = min(abs(pos), abs(q))
                    gain = closed * (price - avg) * (1 if pos > 0 else -1)
                    if abs(q) > abs(pos):
                        avg = price  # the position turns over
                    elif abs(q) == abs(pos):
                        avg = 0.0
                pos += q
                out.append((pos, avg, gain))
            made = [pa.array([x[k] for x in out], pa.float64(), from_pandas=True) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + made, names=[*names, "position", "avg_price", "realised"])

    names = fills.columns
    # the window deals the rows by key and puts them in order, which the map keeps
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last(order))) == 1
    schema = StructType([*fills.schema.fields, *(StructField(c, DoubleType()) for c in ("position", "avg_price", "realised"))])
    return fills.withColumn("_first", first).mapInArrow(run, schema)


def daily_report(orders: DataFrame, keys: list[str], day: Column, *, status: str, amount: str, filled: str) -> DataFrame:
    return orders.groupBy(day.alias("day"), *keys).agg(
        F.count("*").alias("orders"), F.count_if(F.col(status) == filled).alias("filled"), F.sum(amount).alias("volume"), F.avg(amount).alias("avg_amount"), F.max(amount).alias("max_amount")
    )


def performance(trades: DataFrame, keys: list[str], order: list[str], *, pnl: str = "pnl", price: str = "price") -> DataFrame:
    """Counts, total, mean, greatest win and loss, win rate as a share, Sharpe ratio of pnl over price, and the largest
    fall of the summed pnl from its peak, as a share of a peak above 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = trades.withColumn("_sum", F.sum(pnl).over(w)).withColumn("_peak", F.greatest(F.lit(0.0), F.max("_sum").over(w)))
    fall = F.when(F.col("_peak") > 0, (F.col("_peak") - F.col("_sum")) / F.col("_peak"))
    p = F.col(pnl)
    return t.groupBy(*keys).agg(
        F.count("*").alias("trades"), F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), F.sum(p).alias("total_pnl"), F.avg(p).alias("avg_pnl"), F.max(p).alias("max_win"), F.min(p).alias("max_loss"),
        (F.count_if(p > 0) / F.count("*")).alias("win_rate"), sharpe(p / F.nullif(F.col(price), F.lit(0.0))).alias("sharpe"), F.coalesce(F.max(fall), F.lit(0.0)).alias("max_drawdown"),
    )


def trades_report(trades: DataFrame, keys: list[str], day: Column, *, pnl: str, fee: str, side: str, amount: str) -> DataFrame:
    """Per day: bought and sold amounts, realised profit, fees, profit after fees, and the share of trades that won."""
    p = F.col(pnl)
    return trades.groupBy(day.alias("day"), *keys).agg(
        F.count("*").alias("trades"), F.sum(F.when(F.col(side) == "buy", F.col(amount)).otherwise(0.0)).alias("buy_volume"), F.sum(F.when(F.col(side) == "sell", F.col(amount)).otherwise(0.0)).alias("sell_volume"),
        F.sum(p).alias("pnl"), F.sum(fee).alias("fees"), (F.sum(p) - F.sum(fee)).alias("net_pnl"), (F.count_if(p > 0) / F.count("*")).alias("win_rate"),
    )


def newest_trades(trades: DataFrame, *, symbol: str | None = None, start: int | None = None, end: int | None = None, limit: int = 100, ts: str = "timestamp", unique: str = "id") -> DataFrame:
    """The newest trades of a symbol and a closed time range, newest first."""
    t = trades if symbol is None else trades.where(F.col("symbol") == symbol)
    t = t if start is None else t.where(F.col(ts) >= start)
    t = t if end is None else t.where(F.col(ts) <= end)
    return t.orderBy(F.desc(ts), F.desc(unique)).limit(limit)


def last_metrics(metrics: DataFrame, n: int, *, keys: list[str], ts: str = "timestamp", unique: str = "id") -> DataFrame:
    """The last ``n`` rows of each series, in ascending order of time."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(ts), F.desc(unique))
    return metrics.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= n).drop("_n").orderBy(*keys, ts, unique)


def rank_runs(results: DataFrame, by: str = "sharpe", *, unique: list[str]) -> DataFrame:
    """Runs of a parameter sweep with their rank, best first; runs without a value come last."""
    return results.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last(by), *unique)))


def marked_equity(positions: DataFrame, marks: DataFrame, keys: list[str], *, cash: str, position: str, average: str) -> DataFrame:
    """Each account's cash, value of its positions at the marks (of (symbol, price)), and their sum: positions without a
    mark count at their average price."""
    price = F.coalesce(F.col("price"), F.col(average))
    held = positions.join(marks.select("symbol", "price"), "symbol", "left")
    value = F.sum(F.col(position) * price)
    return held.groupBy(*keys).agg(F.max(cash).alias("cash"), value.alias("held"), F.sum(F.col(position) * (price - F.col(average))).alias("unrealised")).withColumn("equity", F.col("cash") + F.col("held"))


def risk_limits(totals: DataFrame, exposure: str, limit: float) -> DataFrame:
    """VIOLATION above the limit, WARNING from 90 % of it on."""
    x = F.col(exposure)
    return totals.withColumn("usage", x / limit).withColumn("status", F.when(x > limit, "VIOLATION").when(x >= 0.9 * limit, "WARNING").otherwise("OK"))


def param_grid(spark, **values: list) -> DataFrame:
    """All combinations of short parameter lists, by exploding literal arrays."""
    df = spark.range(1).drop("id")
    for name, options in values.items():
        df = df.select("*", F.explode(F.array(*map(F.lit, options))).alias(name))
    return df
