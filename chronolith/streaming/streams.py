"""Bars with watermarks, incremental indicators with keyed state, and an upserting sink."""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

RUN_ROWS, MERGE_ROWS, FAN_IN, OUT_ROWS = 200_000, 4096, 64, 10_000  # rows sorted in memory, held of each run, runs merged at a time, rows of a frame
KEY, NO_KEY = ("ts", "id", "at"), np.iinfo("int64").max


def file_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 8, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(path)


def stream_bars(ticks: DataFrame, every: str, late: str, *, slide: str | None = None, ts: str = "ts", key: str = "symbol", price: str = "price", volume: str = "volume", unique: str = "id") -> DataFrame:
    """Bars of event-time windows, tumbling or sliding; rows later than the watermark are dropped and their state is freed."""
    order = F.struct(ts, unique)
    window = F.window(ts, every, slide) if slide else F.window(ts, every)
    bars = ticks.withWatermark(ts, late).groupBy(window, key)
    return bars.agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, order).alias("close"), F.sum(volume).alias("volume"), F.count("*").alias("n")
    ).select(key, F.col("window.start").alias("bar_start"), "open", "high", "low", "close", "volume", "n")


class Indicator:
    """One incremental indicator: ``state`` is a list of numbers, ``update`` takes a value and gives the outputs."""

    names: tuple[str, ...] = ()

    def __init__(self):
        self.state: list[float] = []

    def update(self, x: float) -> tuple[float, ...]:
        raise NotImplementedError


class Sma(Indicator):
    """Mean of the last n values, of fewer at first."""

    names = ("sma",)

    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def update(self, x: float) -> tuple[float, ...]:
        self.state = [*self.state, x][-self.n :]
        return (math.fsum(self.state) / len(self.state),)


class Bollinger(Sma):
    """Bands of k deviations around the mean of the last n values, of fewer at first."""

    names = ("middle", "upper", "lower")

    def __init__(self, n: int = 20, k: float = 2.0):
        super().__init__(n)
        self.k = k

    def update(self, x: float) -> tuple[float, ...]:
        (mid,) = super().update(x)
        dev = math.sqrt(math.fsum((v - mid) ** 2 for v in self.state) / len(self.state))
        return mid, mid + self.k * dev, mid - self.k * dev


class Ema(Indicator):
    """Exponential average from the first value."""

    names = ("ema",)

    def __init__(self, n: int):
        super().__init__()
        self.alpha = 2 / (n + 1)

    def update(self, x: float) -> tuple[float, ...]:
        self.state = [x if not self.state else self.alpha * x + (1 - self.alpha) * self.state[0]]
        return (self.state[0],)


def _seeded(state: list[float], x: float, n: int, alpha: float) -> list[float]:
    """(values taken, their mean or the smoothed value): the mean of the first n values, smoothed from then on."""
    count, value = state
    if count < n:
        return [count + 1, value + (x - value) / (count + 1)]
    return [count, alpha * x + (1 - alpha) * value]


class Rsi(Indicator):
    """Wilder's RSI; 0 before n changes, ``no_loss`` where the average loss is 0."""

    names = ("rsi",)

    def __init__(self, n: int = 14, no_loss: float = 100.0):
        super().__init__()
        self.n, self.no_loss = n, no_loss

    def update(self, x: float) -> tuple[float, ...]:
        if not self.state:
            self.state = [x, 0.0, 0.0, 0.0, 0.0]
            return (0.0,)
        change = x - self.state[0]
        gain = _seeded(self.state[1:3], max(change, 0.0), self.n, 1 / self.n)
        loss = _seeded(self.state[3:5], max(-change, 0.0), self.n, 1 / self.n)
        self.state = [x, *gain, *loss]
        if gain[0] < self.n:
            return (0.0,)
        return (self.no_loss if loss[1] == 0 else 100 - 100 / (1 + gain[1] / loss[1]),)


class Macd(Indicator):
    """MACD of averages seeded with means; 0 until each line is defined."""

    names = ("macd", "signal", "histogram")

    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9):
        super().__init__()
        self.n = fast, slow, signal

    def update(self, x: float) -> tuple[float, ...]:
        s = self.state or [0.0] * 6
        step = lambda k, v: _seeded(s[2 * k : 2 * k + 2], v, self.n[k], 2 / (self.n[k] + 1))
        fast, slow, signal = step(0, x), step(1, x), s[4:6]
        ready = min(fast[0] - self.n[0], slow[0] - self.n[1]) >= 0
        line = fast[1] - slow[1] if ready else 0.0
        if ready:
            signal = step(2, line)
        self.state = [*fast, *slow, *signal]
        if signal[0] < self.n[2]:
            return line, 0.0, 0.0
        return line, signal[1], line - signal[1]


def _ordered(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    whole = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    order = np.lexsort((whole["at"], whole["id"], whole["ts"]))
    return {c: x[order] for c, x in whole.items()}


def _rows(frame: pd.DataFrame, at: int) -> dict[str, np.ndarray]:
    """A frame's columns as numbers; missing times and ids come last. ``at`` is the first row's number of arrival."""

    def time(x: pd.Series) -> np.ndarray:
        if pd.api.types.is_datetime64_any_dtype(x):
            return x.astype("datetime64[us]").to_numpy().view("i8")
        bits = (x.astype(float).to_numpy() + 0.0).view("i8")  # in the order of the numbers
        return np.where(bits < 0, bits ^ NO_KEY, bits)

    reset = frame["reset"].eq(True).to_numpy(bool) if "reset" in frame else np.zeros(len(frame), bool)
    key = {"ts": np.where(frame["ts"].isna(), NO_KEY, time(frame["ts"])), "id": np.where(frame["id"].isna(), NO_KEY, frame["id"].fillna(0).astype("int64"))}
    return {**key, "at": np.arange(at, at + len(frame)), "price": frame["price"].astype(float).to_numpy(), "reset": reset}


class _Run:
    """Ordered rows in a file, of which one batch is held."""

    def __init__(self, path: str):
        self.file = pa.OSFile(path)
        self.reader, self.next, self.held = pa.ipc.open_file(self.file), 0, {}
        self.fill()

    def fill(self) -> bool:
        """Holds the next batch if none is left; whether there are rows."""
        if not (self.held and len(self.held["ts"])):
            if self.next == self.reader.num_record_batches:
                return False
            batch, self.next = self.reader.get_batch(self.next), self.next + 1
            self.held = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        return True

    def last(self) -> tuple[int, int, int]:
        return tuple(int(self.held[c][-1]) for c in KEY)

    def take(self, bound: tuple[int, int, int]) -> dict[str, np.ndarray]:
        """The held rows up to the bound."""
        ts, id, at = (self.held[c] for c in KEY)
        n = int(((ts < bound[0]) | ((ts == bound[0]) & ((id < bound[1]) | ((id == bound[1]) & (at <= bound[2]))))).sum())
        out, self.held = {c: x[:n] for c, x in self.held.items()}, {c: x[n:] for c, x in self.held.items()}
        return out


def _merged(paths: list[str]) -> Iterator[dict[str, np.ndarray]]:
    runs = [_Run(p) for p in paths]
    try:
        while left := [r for r in runs if r.fill()]:
            bound = min(r.last() for r in left)
            yield _ordered([r.take(bound) for r in left])
    finally:
        for r in runs:
            r.file.close()


def _write(path: str, parts: Iterator[dict[str, np.ndarray]]) -> str:
    out = None
    with pa.OSFile(path, "wb") as file:
        for part in parts:
            batch = pa.record_batch(part)
            out = out or pa.ipc.new_file(file, batch.schema)
            out.write_table(pa.Table.from_batches([batch]), max_chunksize=MERGE_ROWS)
        out.close()
    return path


def in_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (id, price, reset) in order of (ts, id), in frames of bounded size; equal ones stay as they come.

    RUN_ROWS rows are sorted in memory. More go to runs in a temporary folder, which are merged, FAN_IN at a time, each
    holding MERGE_ROWS."""
    with tempfile.TemporaryDirectory(prefix="chronolith-") as folder:
        held, size, seen, paths = [], 0, 0, []
        for frame in frames:
            held.append(_rows(frame, seen))
            size, seen = size + len(frame), seen + len(frame)
            if size >= RUN_ROWS:
                paths.append(_write(f"{folder}/{len(paths)}", iter([_ordered(held)])))
                held, size = [], 0
        if not paths:
            parts = iter([_ordered(held)] if held else [])
        else:
            if held:
                paths.append(_write(f"{folder}/{len(paths)}", iter([_ordered(held)])))
            held, made = [], len(paths)
            while len(paths) > FAN_IN:
                some, paths = paths[:FAN_IN], paths[FAN_IN:]
                paths.append(_write(f"{folder}/{made}", _merged(some)))
                made += 1
                for p in some:
                    os.remove(p)
            parts = _merged(paths)
        for part in parts:
            for i in range(0, len(part["ts"]), OUT_ROWS):
                ids = part["id"][i : i + OUT_ROWS]
                ids = pd.Series(ids, dtype="Int64").mask(ids == NO_KEY) if (ids == NO_KEY).any() else ids
                yield pd.DataFrame({"id": ids, **{c: part[c][i : i + OUT_ROWS] for c in ("price", "reset")}})


class _Indicators(StatefulProcessor):
    """Per key the states of some indicators. A trigger's rows of a key are put in order together, in bounded memory."""

    def __init__(self, make: Callable[[], list[Indicator]]):
        self.make = make

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "states array<array<double>>")

    def _load(self) -> list[Indicator]:
        found, state = self.make(), self.held.get()
        for x, values in zip(found, state[0] if state else []):
            x.state = list(values)
        return found

    def _save(self, found: list[Indicator]) -> None:
        self.held.update(([x.state for x in found],))

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        found = self._load()
        for x in initialState.sort_values(["ts", "id"])["price"]:
            for f in found:
                f.update(float(x))
        self._save(found)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        found = self._load()
        names = [n for f in found for n in f.names]
        for part in in_order(rows):
            out = []
            for x, again in zip(part["price"].tolist(), part["reset"].tolist()):
                if again:
                    found = self.make()
                out.append([v for f in found for v in f.update(x)])
            head = pd.DataFrame({"symbol": [key[0]] * len(part), "id": part["id"], "price": part["price"]})
            yield pd.concat([head, pd.DataFrame(out, columns=names, dtype=float)], axis=1)
        self._save(found)

    def close(self) -> None:
        pass


def stream_indicators(ticks: DataFrame, make: Callable[[], list[Indicator]], *, history: DataFrame | None = None) -> DataFrame:
    """The outputs of indicators (``make`` gives new ones), updated row by row.

    ``ticks`` has symbol, id, ts and price; a row that is true in an optional column ``reset`` begins anew. Rows of one trigger
    are put in order of (ts, id); a row that comes triggers later than later ones is taken when it comes. ``history`` is a table
    of rows that bring each key's state up to date before the first trigger. A key's rows of one trigger
    are sorted in runs of RUN_ROWS, which lie in the executor's temporary folder until they are merged. The session must use
    the RocksDB state store."""
    out = ["symbol string", "id long", "price double", *[f"{n} double" for x in make() for n in x.names]]
    start = None if history is None else history.select("symbol", "id", "ts", "price").groupBy("symbol")
    return ticks.groupBy("symbol").transformWithStateInPandas(statefulProcessor=_Indicators(make), outputStructType=", ".join(out), outputMode="append", timeMode="None", initialState=start)


def stream_indicator(ticks: DataFrame, n: int) -> DataFrame:
    """SMA over the last n rows (fewer at first) and EMA from the first value."""
    return stream_indicators(ticks, lambda: [Sma(n), Ema(n)])


def upsert_sink(apply: Callable[[DataFrame], None], keys: list[str], seq: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands on one row for each key of a batch, the last by ``seq``."""

    def write(batch: DataFrame, epoch: int) -> None:
        rest = [c for c in batch.columns if c not in keys]
        apply(batch.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*"))

    return write


def run_to_table(stream: DataFrame, path: str, mode: str) -> DataFrame:
    """Runs a stream over what is there and returns the result, written as Parquet under ``path``, which all executors reach.

    A trigger that is repeated writes its folder anew."""
    complete, epochs = mode == "complete", []

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/result/part={0 if complete else epoch}")
        epochs.append(epoch)

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{path}/result").select(stream.columns) if epochs else spark.createDataFrame([], stream.schema)
