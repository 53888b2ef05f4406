"""Technical indicators as window expressions: one sort of each series, no Python.

Recursive averages are windows as well. With decay q, y_t = q y_(t-1) + b_t, so inside a stretch of a series y is a
running sum of b_i q^-i times q^t. A stretch is long enough that q^length is below 1e-40: what comes before the
previous stretch does not reach a double's last digit, and the previous stretch's last value is all that is carried.
Rows before an indicator is defined have null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Series:
    """Windows over one kind of series: its keys and a total order."""

    def __init__(self, keys: list[str], order: list[str]):
        self.keys, self.order = keys, order

    @property
    def by(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def running(self):
        return self.by.rowsBetween(Window.unboundedPreceding, 0)

    def last(self, n: int):
        return self.by.rowsBetween(1 - n, 0)

    def full(self, n: int, x: Column) -> Column:
        """``x`` from the n-th row on."""
        return F.when(F.row_number().over(self.by) >= n, x)

    def sma(self, v: str, n: int, warm: str = "null") -> Column:
        x = F.avg(v).over(self.last(n))
        return x if warm == "expanding" else self.full(n, x)

    def wma(self, v: str, n: int) -> Column:
        total = sum((F.lag(v, k).over(self.by) if k else F.col(v)) * (n - k) for k in range(n))
        return self.full(n, total / (n * (n + 1) / 2))

    def momentum(self, v: str, n: int) -> Column:
        return F.col(v) - F.lag(v, n).over(self.by)

    def roc(self, v: str, n: int) -> Column:
        old = F.lag(v, n).over(self.by)
        return (F.col(v) - old) / F.nullif(old, F.lit(0.0)) * 100

    def std(self, v: str, n: int, warm: str = "null") -> Column:
        """Population deviation; ``warm``: null, zero or expanding."""
        x = F.stddev_pop(v).over(self.last(n))
        return x if warm == "expanding" else F.coalesce(self.full(n, x), F.lit(0.0)) if warm == "zero" else self.full(n, x)

    def least(self, v: str, n: int) -> Column:
        return F.min(v).over(self.last(n))

    def greatest(self, v: str, n: int) -> Column:
        return F.max(v).over(self.last(n))

    def bollinger(self, v: str, n: int = 20, k: float = 2.0) -> dict[str, Column]:
        mid, dev = self.sma(v, n), self.std(v, n)
        up, low = mid + k * dev, mid - k * dev
        return {"middle": mid, "upper": up, "lower": low, "bandwidth": F.when(mid > 0, (up - low) / mid).when(mid.isNotNull(), 0.0)}

    def percent_b(self, v: str, n: int = 20, k: float = 2.0) -> Column:
        """Where a value lies between the Bollinger bands; null where they meet."""
        b = self.bollinger(v, n, k)
        return (F.col(v) - b["lower"]) / F.nullif(b["upper"] - b["lower"], F.lit(0.0))

    def mean_move(self, v: str, n: int) -> Column:
        """Mean absolute change over the last n changes, from row n + 1 on."""
        at = lambda k: F.lag(v, k).over(self.by) if k else F.col(v)
        return sum(F.abs(at(k) - at(k + 1)) for k in range(n)) / n

    def grid_spacing(self, v: str, n: int, base: float, least: float, most: float) -> Column:
        """A spacing in proportion to volatility, within bounds."""
        return F.greatest(F.lit(least), F.least(F.lit(most), F.lit(base) * (1 + F.coalesce(self.volatility(v, n), F.lit(0.0)) * 100)))

    def obv(self, close: str = "close", volume: str = "volume") -> Column:
        before = F.lag(close).over(self.by)
        sign = F.when(before.isNull(), 1).when(F.col(close) > before, 1).when(F.col(close) < before, -1).otherwise(0)
        return sign * F.col(volume)  # summed by with_obv: a window inside a window needs a column between

    def vwap(self, n: int | None = None) -> Column:
        """Volume-weighted typical price, cumulative or over n rows; 0 without volume."""
        w = self.running if n is None else self.last(n)
        typical = (F.col("high") + F.col("low") + F.col("close")) / 3
        total = F.sum("volume").over(w)
        return F.coalesce(F.sum(typical * F.col("volume")).over(w) / F.nullif(total, F.lit(0)), F.lit(0.0))

    def vwap_close(self, n: int | None = None, close: str = "close") -> Column:
        """Volume-weighted close, cumulative or over n rows; null where the window has no volume (see :func:`with_vwap_close`)."""
        w = self.running if n is None else self.last(n)
        return F.sum(F.col(close) * F.col("volume")).over(w) / F.nullif(F.greatest(F.sum("volume").over(w), F.lit(0.0)), F.lit(0.0))

    def true_range(self, first: str = "range") -> Column:
        before = F.lag("close").over(self.by)
        span = F.col("high") - F.col("low")
        tr = F.greatest(span, F.abs(F.col("high") - before), F.abs(F.col("low") - before))
        return F.when(before.isNull(), span if first == "range" else F.lit(None)).otherwise(tr)

    def volatility(self, v: str, n: int) -> Column:
        mean = F.avg(v).over(self.last(n))
        return F.stddev_pop(v).over(self.last(n)) / F.nullif(mean, F.lit(0.0))


def row_numbers(df: DataFrame, s: Series) -> DataFrame:
    """Adds ``_n``, the row's number in its series, for several calls of :func:`smooth`."""
    return df.withColumn("_n", F.row_number().over(s.by))


def smooth(df: DataFrame, s: Series, value: str, out: str, *, alpha: float, seed: int | None = None, skip: int = 0) -> DataFrame:
    """Exponential average from row ``skip`` on: seeded with its first value, or with the mean of its first ``seed``.

    Windows only: rows are dealt by series once, and sorted once more by stretch; nothing is joined."""
    q = 1.0 - alpha
    length = max(2, math.ceil(40 / -math.log10(q)))
    first = skip + (seed or 1)  # the row (from 1) that holds the seed
    t = df if "_n" in df.columns else row_numbers(df, s)
    begin = F.col(value) if not seed else F.avg(value).over(s.by.rowsBetween(1 - seed, 0))
    t = t.withColumn("_b", F.when(F.col("_n") > first, F.lit(alpha) * F.col(value)).when(F.col("_n") == first, begin).otherwise(F.lit(None)))
    t = t.withColumn("_c", F.expr(f"case when _n >= {first} then (_n - {first}) div {length} end")).withColumn("_j", F.col("_n") - first - F.col("_c") * length)
    inside = Window.partitionBy(*s.keys, "_c").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("_z", F.pow(F.lit(q), F.col("_j")) * F.sum(F.col("_b") * F.pow(F.lit(q), -F.col("_j"))).over(inside))
    # the last value of the stretch before: the latest end of a stretch above this row, in the order the rows already have
    before = Window.partitionBy(*s.keys).orderBy("_c", "_n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.last(F.when(F.col("_j") == length - 1, F.col("_z")), ignorenulls=True).over(before)
    y = F.col("_z") + F.coalesce(F.pow(F.lit(q), F.col("_j") + 1) * end, F.lit(0.0))
    return t.withColumn(out, F.when(F.col("_n") >= first, y)).select(*df.columns, out)


def ema(df: DataFrame, s: Series, value: str, n: int, *, seed: str = "first", out: str = "ema") -> DataFrame:
    """EMA with alpha = 2 / (n + 1); seeded with the first value, or with the mean of the first n."""
    return smooth(df, s, value, out, alpha=2 / (n + 1), seed=n if seed == "sma" else None)


def macd(df: DataFrame, s: Series, value: str, fast: int = 12, slow: int = 26, signal: int = 9, *, seed: str = "first") -> DataFrame:
    """macd, signal and histogram. ``first``: EMAs from the first value, signal from row ``slow`` on;
    ``sma``: all three seeded with means."""
    t = ema(ema(row_numbers(df, s), s, value, fast, seed=seed, out="_f"), s, value, slow, seed=seed, out="_s")
    t = t.withColumn("_m", F.col("_f") - F.col("_s"))
    t = smooth(t, s, "_m", "signal", alpha=2 / (signal + 1), seed=signal if seed == "sma" else None, skip=slow - 1)
    return t.withColumn("macd", F.when(F.col("_n") >= slow, F.col("_m"))).withColumn("histogram", F.col("macd") - F.col("signal")).drop("_f", "_s", "_m", "_n")


def rsi(df: DataFrame, s: Series, value: str, n: int = 14, *, no_loss: float = 100.0) -> DataFrame:
    """Wilder's RSI, from row n + 1 on; ``no_loss`` is the value where the average loss is 0."""
    d = F.col(value) - F.lag(value).over(s.by)
    t = row_numbers(df, s).withColumns({"_g": F.greatest(d, F.lit(0.0)), "_l": F.greatest(-d, F.lit(0.0))})
    for c in ("_g", "_l"):
        t = smooth(t, s, c, f"{c}a", alpha=1 / n, seed=n, skip=1)
    gain, loss = F.col("_ga"), F.col("_la")
    x = F.when(loss.isNull(), F.lit(None)).when(loss == 0, no_loss).otherwise(100 - 100 / (1 + gain / F.nullif(loss, F.lit(0.0))))
    return t.withColumn("rsi", x).drop("_g", "_l", "_ga", "_la", "_n")


def atr(df: DataFrame, s: Series, n: int = 14, *, first: str = "range") -> DataFrame:
    """Wilder's ATR. ``range``: the first true range is high - low, the first ATR at row n; ``none``: at row n + 1."""
    t = df.withColumn("_tr", s.true_range(first))
    return smooth(t, s, "_tr", "atr", alpha=1 / n, seed=n, skip=0 if first == "range" else 1).drop("_tr")


def with_obv(df: DataFrame, s: Series) -> DataFrame:
    return df.withColumn("_o", s.obv()).withColumn("obv", F.sum("_o").over(s.running)).drop("_o")


def adx(df: DataFrame, s: Series, n: int = 14, *, trending: float = 25.0, strong: float = 40.0) -> DataFrame:
    """ADX from rolling sums of directional movement, and the regime it names."""
    up = F.col("high") - F.lag("high").over(s.by)
    down = F.lag("low").over(s.by) - F.col("low")
    t = df.withColumns({"_u": F.when((up > down) & (up > 0), up).otherwise(0.0), "_d": F.when((down > up) & (down > 0), down).otherwise(0.0), "_t": s.true_range("none")})
    w = s.last(n)
    di = lambda c: 100 * F.sum(c).over(w) / F.nullif(F.sum("_t").over(w), F.lit(0.0))
    t = t.withColumns({"_pi": di("_u"), "_mi": di("_d")})
    t = t.withColumn("_dx", F.when(F.row_number().over(s.by) > n, F.coalesce(100 * F.abs(F.col("_pi") - F.col("_mi")) / F.nullif(F.col("_pi") + F.col("_mi"), F.lit(0.0)), F.lit(0.0))))
    t = t.withColumn("adx", F.when(F.row_number().over(s.by) >= 2 * n, F.avg("_dx").over(w)))
    regime = F.when(F.col("adx") >= strong, "STRONG_TREND").when(F.col("adx") >= trending, "TRENDING").when(F.col("adx").isNotNull(), "RANGING")
    return t.withColumn("regime", regime).drop("_u", "_d", "_t", "_pi", "_mi", "_dx")


def with_vwap_close(df: DataFrame, s: Series, n: int | None = None, out: str = "vwap") -> DataFrame:
    """Volume-weighted close that keeps its last value while its window has no volume; rows without a close or with a
    negative volume keep it too."""
    good = F.col("close").isNotNull() & (F.col("volume") >= 0)
    t = df.withColumn("_v", s.vwap_close(n)) if n is None else df.withColumn("_ok", F.coalesce(good, F.lit(False)))
    if n is not None:  # windows count good rows alone
        w = Window.partitionBy(*s.keys, "_ok").orderBy(*s.order).rowsBetween(1 - n, 0)
        t = t.withColumn("_v", F.when(F.col("_ok"), F.sum(F.col("close") * F.col("volume")).over(w) / F.nullif(F.sum("volume").over(w), F.lit(0.0)))).drop("_ok")
    return t.withColumn(out, F.last("_v", ignorenulls=True).over(s.running)).drop("_v")


def valid_sma(df: DataFrame, s: Series, v: str, n: int, out: str = "sma") -> DataFrame:
    """Means of n rows, without the rows before the n-th; a series of fewer rows is an error."""
    t = row_numbers(df, s).withColumn("_all", F.count("*").over(Window.partitionBy(*s.keys)))
    enough = F.when(F.col("_all") >= n, F.avg(v).over(s.last(n))).otherwise(F.raise_error(F.concat(F.lit(f"fewer than {n} rows: "), F.col("_all").cast("string"))))
    return t.withColumn(out, enough).where((F.col("_n") >= n) | (F.col("_all") < n)).drop("_n", "_all")


#: What :func:`indicators` can compute, by name and number of rows.
MOVING = {
    "sma": lambda s, v, n: s.sma(v, n), "wma": lambda s, v, n: s.wma(v, n), "std": lambda s, v, n: s.std(v, n), "min": lambda s, v, n: s.least(v, n), "max": lambda s, v, n: s.greatest(v, n),
    "momentum": lambda s, v, n: s.momentum(v, n), "roc": lambda s, v, n: s.roc(v, n), "volatility": lambda s, v, n: s.volatility(v, n),
}
SMOOTHED = {"ema": lambda t, s, v, n: ema(t, s, v, n, out=f"ema{n}"), "rsi": lambda t, s, v, n: rsi(t, s, v, n).withColumnRenamed("rsi", f"rsi{n}"), "atr": lambda t, s, v, n: atr(t, s, n).withColumnRenamed("atr", f"atr{n}")}


def indicators(df: DataFrame, s: Series, value: str, names: list[str]) -> DataFrame:
    """Any of the registered indicators by name, such as ``sma5``, ``rsi14`` or ``macd``, as columns."""
    moving = {}
    for name in names:
        kind, n = name.rstrip("0123456789"), name[len(name.rstrip("0123456789")) :]
        if kind in MOVING and n:
            moving[name] = MOVING[kind](s, value, int(n))
        elif kind in SMOOTHED and n:
            df = SMOOTHED[kind](df, s, value, int(n))
        elif name == "macd":
            df = macd(df, s, value)
        else:
            raise ValueError(f"unknown indicator {name!r}")
    return df.withColumns(moving) if moving else df


def indicator_set(df: DataFrame, s: Series, value: str, windows: tuple[int, ...] = (5, 20)) -> DataFrame:
    """The usual moving indicators of a series in one pass over one sort."""
    cols = {}
    for n in windows:
        cols |= {f"sma{n}": s.sma(value, n), f"std{n}": s.std(value, n), f"min{n}": s.least(value, n), f"max{n}": s.greatest(value, n)}
    return df.withColumns(cols)
