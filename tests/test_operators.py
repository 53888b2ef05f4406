"""Small fixed cases of operators and the dialect."""

import functools
import math
import random

import pytest
from pyspark.sql import functions as F

from chronolith.functions import asset_class, cosine, round_half_up, strftime
from chronolith.operators import indicators as ind
from chronolith.operators import mutations as mut
from chronolith.operators import timeseries as ts
from chronolith.plans import Dialect
from chronolith.schemas import interval_ms
from chronolith.sources import export, ingest_csv, ingest_jsonl, write_by_day

S = ind.Series(["symbol"], ["timestamp"])


def series(spark, values, symbol="x"):
    return spark.createDataFrame([(symbol, i, float(v)) for i, v in enumerate(values)], "symbol string, timestamp long, close double")


def values(df, c):
    return [r[c] for r in df.orderBy("symbol", "timestamp").collect()]


def test_sma_warm_up(spark):
    df = series(spark, [10, 11, 12, 13, 14])
    assert values(df.withColumn("s", S.sma("close", 3)), "s") == [None, None, 11, 12, 13]
    assert values(df.withColumn("s", S.sma("close", 3, "expanding")), "s") == [10, 10.5, 11, 12, 13]


@pytest.mark.parametrize("seed", ["first", "sma"])
@pytest.mark.parametrize("n", [2, 5, 60])
def test_ema_over_many_stretches(spark, seed, n):
    rng = random.Random(n)
    x = [rng.uniform(-100, 100) for _ in range(4000)]
    want, y = [], None
    for i, v in enumerate(x):
        if seed == "first":
            y = v if y is None else 2 / (n + 1) * v + (1 - 2 / (n + 1)) * y
        elif i == n - 1:
            y = sum(x[:n]) / n
        elif i >= n:
            y = 2 / (n + 1) * v + (1 - 2 / (n + 1)) * y
        want.append(y)
    got = values(ind.ema(series(spark, x), S, "close", n, seed=seed), "ema")
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got, want))


def test_rsi_without_losses(spark):
    got = values(ind.rsi(series(spark, range(30)), S, "close"), "rsi")
    assert got[:14] == [None] * 14 and got[14:] == [100.0] * 16


def test_resample_keeps_row_groups(spark):
    rows = [("x", "1m", 1700000000000 + 60000 * i, 100.0 + 5 * i, 110.0 + 5 * i, 95.0 + 5 * i, 105.0 + 5 * i, 10.0 * (i + 1)) for i in range(10)]
    df = spark.createDataFrame(rows, "symbol string, interval string, timestamp long, open double, high double, low double, close double, volume double")
    got = ts.resample(df, 5, keys=["symbol"]).orderBy("timestamp").collect()
    assert [(r.open, r.low, r.volume) for r in got] == [(100, 95, 150), (125, 120, 400)]


def test_upsert_and_merge(spark):
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    new = spark.createDataFrame([(2, "c", 9.0), (3, "d", 3.0)], "k int, s string, v double")
    assert sorted(map(tuple, mut.upsert(base, new, ["k"]).collect())) == [(1, "a", 1.0), (2, "c", 9.0), (3, "d", 3.0)]
    assert sorted(map(tuple, mut.upsert(base, new, ["k"], ["v"]).collect())) == [(1, "a", 1.0), (2, "b", 9.0), (3, "d", 3.0)]
    assert mut.merge_absent(new, base, ["k"]).count() == 3
    assert sorted(r.k for r in mut.delete_where(base, F.col("v") > 1).collect()) == [1]


def test_scalars(spark):
    row = spark.createDataFrame([(-2.5, 1700000000000)], "x double, t long").select(round_half_up(F.col("x")).alias("a"), strftime(F.col("t"), "%Y-%m-%d %H:%M:%S").alias("b"), asset_class(F.lit("BTCUSDT")).alias("c")).first()
    assert tuple(row) == (-2.0, "2023-11-14 22:13:20", "crypto")
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in v.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]
    assert interval_ms("15m") == 900_000


def test_dialect_statements(spark):
    d = Dialect(spark)
    d.sql("CREATE TABLE bars (symbol STRING, ts BIGINT, close DOUBLE)")
    d.sql("INSERT INTO bars VALUES ('a', 1, 1.5), ('a', 2, 2.5), ('b', 1, 9)")
    d.sql("INSERT INTO bars (symbol, ts, close) VALUES ('a', 2, 7), ('c', 1, 4) ON CONFLICT (symbol, ts) DO UPDATE SET close = EXCLUDED.close")
    d.sql("UPSERT INTO bars VALUES ('b', 1, 8) KEY(symbol, ts)")
    assert sorted(map(tuple, d.sql("SELECT * FROM bars").collect())) == [("a", 1, 1.5), ("a", 2, 7.0), ("b", 1, 8.0), ("c", 1, 4.0)]
    with pytest.raises(ValueError):
        d.sql("CREATE TABLE bars (x INT)")
    got = d.sql("SELECT symbol, SUM(close) OVER (PARTITION BY symbol ORDER BY ts) AS s FROM bars WHERE symbol LIKE 'A' ORDER BY ts").collect()
    assert [r.s for r in got] == [1.5, 8.5]
    got = d.sql("SELECT ts, LAG(close) AS p FROM bars WHERE symbol = 'a' ORDER BY ts").collect()
    assert [r.p for r in got] == [None, 1.5]
    assert d.sql("SELECT STDDEV(close) AS s, PERCENTILE(close, 50) AS p, ROUND(2.345, 2) AS r FROM bars WHERE symbol = 'c'").first()[:2] == (0.0, 4.0)


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("symbol,interval,timestamp,open,high,low,close,volume\nx,1m,1,1,2,0.5,1.5,10\nx,1m,oops\ny,1m,2,1,2,0.5,1.5,-1\n")
    rows, bad = ingest_csv(spark, str(tmp_path / "a.csv"))
    assert rows.count() == 2 and bad.count() == 1
    (tmp_path / "a.jsonl").write_text('{"timestamp": 5, "symbol": "x", "interval": "1m", "close": 2}\n{"symbol": "x"}\nnot json\n')
    good, bad = ingest_jsonl(spark, str(tmp_path / "a.jsonl"))
    assert good.count() == 1 and bad.count() == 2
    write_by_day(rows, str(tmp_path / "days"))
    assert spark.read.parquet(str(tmp_path / "days")).count() == 2
    export(rows, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_plans_prune_and_combine(spark, sf):
    from chronolith import catalog

    plan = catalog.QUERIES["filter_compare"](spark, sf)._jdf.queryExecution().toString()
    assert "GreaterThan(o_totalprice" in plan and "o_orderdate" not in plan.split("ReadSchema")[-1]
    plan = catalog.QUERIES["head_n"](spark, sf)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("threshold", [0.4, 0.9, 0.0])
def test_similar_pairs_by_blocks(spark, threshold):
    import numpy as np

    from chronolith.operators import facts, vectors

    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(size=(60, 6)), rng.normal(size=(60, 6)) * 0.05 + 1, np.zeros((2, 6)), np.tile(rng.normal(size=6), (20, 1))]).astype("float32")
    v = v[rng.permutation(len(v))]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(900, None), (None, v[0].tolist()), (901, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    u = v.astype(float) / np.maximum(np.linalg.norm(v.astype(float), axis=1, keepdims=True), 1e-300)
    sims = u @ u.T
    want = {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if sims[i, j] >= threshold}
    got = [(r.id_a, r.id_b) for r in vectors.similar_pairs(df, threshold, block=16).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    late = [r.vec_id for r in vectors.similar_to_earlier(df, threshold, block=16).collect()]
    assert len(late) == len(set(late)) and set(late) == {j for _, j in want}
    assert {r.vec_id for r in facts.deduplicate(df, threshold, unique="vec_id").collect()} == {r[0] for r in rows} - {j for _, j in want}


def test_similar_pairs_above_the_former_limit(spark):
    from chronolith.operators import vectors

    n = 20_001
    df = spark.range(n).select(F.col("id").alias("vec_id"), F.array(F.cos(F.col("id") * 0.0003), F.sin(F.col("id") * 0.0003)).alias("embedding"))
    assert vectors.similar_pairs(df, 1 - 0.0004**2 / 2).count() == n - 1
    equal = df.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)))
    assert vectors.similar_to_earlier(equal, 0.95).count() == n - 1


def test_upsert_takes_the_last_change(spark):
    base = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b", 2), (1, "c", 1), (2, "d", 1), (2, "e", 5)], "k int, v string, at int")
    assert sorted(map(tuple, mut.upsert(base, new, ["k"], seq="at").collect())) == [(1, "b"), (2, "e")]
    assert sorted(map(tuple, mut.upsert(base, new.drop("at").coalesce(1), ["k"]).collect())) == [(1, "c"), (2, "e")]


def test_mutations(spark, tmp_path):
    bars = spark.createDataFrame([("x", "1m", i, float(i), 10.0) for i in range(6)] + [("y", "5m", 1, 1.0, 5.0)], "symbol string, interval string, timestamp long, close double, volume double")
    assert [r.close for r in mut.update_row(bars, 2, {"close": F.lit(99.0)}, order=["symbol", "timestamp"]).orderBy("symbol", "timestamp").collect()] == [0, 1, 99, 3, 4, 5, 1]
    assert mut.clear_series(bars, symbol="x", interval="1m").count() == 1
    log = bars.withColumn("seq", F.col("timestamp")).unionByName(bars.where("timestamp = 3").withColumns({"seq": F.lit(50).cast("long"), "volume": F.lit(-1.0)}))
    left = mut.compact(log, str(tmp_path / "c"), ["symbol", "timestamp"], "seq", partition="symbol")
    assert left.count() == 6 and left.where("timestamp = 3").count() == 0
    other = bars.withColumn("timestamp", F.col("timestamp") + 100)
    assert mut.merge_absent(other, bars, ["symbol", "timestamp"], symbols=["y"]).count() == 8
    assert mut.merge_absent(other, bars, ["symbol", "timestamp"], interval="1m").count() == 13
    assert mut.merge_absent(other, bars, ["symbol", "timestamp"], symbols=[]).count() == 7


def test_csv_drops_only_the_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("symbol,interval,timestamp,open,high,low,close,volume\nsymbol-7,1m,1,1,2,0.5,1.5,10\nsymbol,1m,2,1,2,0.5,1.5,10\nsymbol,interval\n")
    rows, bad = ingest_csv(spark, str(tmp_path / "a.csv"))
    assert sorted(r.symbol for r in rows.collect()) == ["symbol", "symbol-7"] and bad.count() == 1


def test_days_tiers_and_exports(spark, tmp_path):
    from chronolith.sources import copy_series, merged_tiers, read_days, synthetic_bars, write_tiers

    bars = synthetic_bars(spark, ["a", "b"], 4000, step=600_000)
    assert bars.count() == 8000 and bars.exceptAll(synthetic_bars(spark, ["a", "b"], 4000, step=600_000)).count() == 0
    from chronolith.operators.data_quality import valid_bars

    assert valid_bars(bars).count() == 8000
    write_by_day(bars, str(tmp_path / "days"))
    start, end = 1_700_100_000_000, 1_700_900_000_000
    got = read_days(spark, str(tmp_path / "days"), start=start, end=end)
    assert got.count() == bars.where(F.col("timestamp").between(start, end)).count()
    assert "PartitionFilters: [isnotnull(day" in got._jdf.queryExecution().toString()
    assert read_days(spark, str(tmp_path / "days"), start=-1).count() == 8000
    write_tiers(bars, str(tmp_path / "hot"), str(tmp_path / "cold"), end)
    assert merged_tiers(spark, str(tmp_path / "hot"), str(tmp_path / "cold")).count() == 8000
    assert spark.read.parquet(str(tmp_path / "hot")).agg(F.min("timestamp")).first()[0] >= end
    copy_series(bars, str(tmp_path / "copy"), symbols=["a"])
    assert spark.read.parquet(str(tmp_path / "copy")).select("symbol").distinct().count() == 1
    export(bars.where("symbol = 'a'").limit(1), str(tmp_path / "csv"), fmt="csv")
    line = spark.read.text(str(tmp_path / "csv")).where("value not like 'symbol%'").first().value.split(",")
    assert line[0] == "a" and all(len(x.split(".")[1]) == 8 for x in line[3:])


def test_vector_lines(spark, tmp_path):
    from chronolith.sources import ingest_vectors

    (tmp_path / "v.jsonl").write_text('{"embedding": [1, 0], "timestamp": 5, "agent_id": "x"}\n{"timestamp": 6, "symbol": "s", "interval": "1m", "close": 2}\n{"symbol": "s"}\nnot json\n{"timestamp": 7, "symbol": "own", "embedding": [0, 1]}\n')
    bars, vectors, bad = ingest_vectors(spark, str(tmp_path / "v.jsonl"))
    assert [r.close for r in bars.collect()] == [2.0] and bad.count() == 2
    assert sorted((r.symbol, r.interval, r.embedding) for r in vectors.collect()) == [("bot-006", "semantic", [1.0, 0.0]), ("own", "semantic", [0.0, 1.0])]


def test_facts(spark, tmp_path):
    from chronolith.operators import facts
    from chronolith.operators.vectors import hash_embedding

    (tmp_path / "f.jsonl").write_text('{"timestamp": 1, "text": "the red fox", "scope": "a", "agent_id": "p"}\n{"timestamp": 2, "embedding": [1, 0], "text": "given", "scope": "b"}\n{"text": "no time"}\n{"timestamp": 3, "text": "a blue whale", "scope": "a", "agent_id": "q"}\n')
    rows, bad = facts.import_jsonl(spark, str(tmp_path / "f.jsonl"))
    assert rows.count() == 3 and bad.count() == 1
    assert rows.where("timestamp = 2").first().embedding == [1.0, 0.0]
    named = rows.withColumn("fact_id", F.col("timestamp"))
    assert [r.fact_id for r in facts.list_facts(named, scope="a").collect()] == [3, 1]
    assert [r.fact_id for r in facts.search(named, "red fox", 1).collect()] == [1]
    assert [r.fact_id for r in facts.search(named, "red fox", 5, agent="q").collect()] in ([3], [])
    assert [facts.duration_ms(x) for x in ("7d", "24h", "1mo", "30m", "2s", "15", "1.5h")] == [604_800_000, 86_400_000, 2_592_000_000, 1_800_000, 2000, 15, 5_400_000]
    with pytest.raises(ValueError):
        facts.duration_ms("7x")
    e = spark.createDataFrame([("a b",), ("A  b",), ("b a",), ("",), (None,)], "t string").select(hash_embedding(F.col("t"), 16).alias("v")).collect()
    assert e[0].v == e[1].v != e[2].v and set(e[3].v) == set(e[4].v) == {0.0} and abs(sum(x * x for x in e[0].v) - 1) < 1e-9


def test_names_and_schemas(spark):
    from chronolith import schemas
    from chronolith.functions import hash_bucket, safe_divide

    assert schemas.missing_columns(spark.createDataFrame([], "symbol string, timestamp long, close double")) == ["interval", "open", "high", "low", "volume"]
    assert schemas.canonical_columns(spark.createDataFrame([], "symbol string, t string, ts long, o double, vol double")).columns == ["symbol", "t", "timestamp", "open", "volume"]
    df = spark.createDataFrame([("60", 10, 0.0), ("7", 61_000, 2.0), ("1h", 60_000, None)], "i string, n long, x double")
    assert [tuple(r) for r in df.select(schemas.canonical_interval(F.col("i")), schemas.bars_count(F.col("n"), "1m"), safe_divide(F.lit(1.0), F.col("x"))).collect()] == [("1h", 1, None), ("7m", 2, 0.5), ("1h", 1, None)]
    assert all(0 <= r[0] < 5 for r in df.select(hash_bucket(F.col("i"), 5)).collect())
    assert schemas.fill_defaults(df).where("x is null").count() == 0


def test_indicators_by_name(spark):
    df = spark.createDataFrame([("x", i, float(10 + i * i % 7)) for i in range(60)], "symbol string, timestamp long, close double")
    df = df.withColumns({"high": F.col("close") + 1, "low": F.col("close") - 1})
    got = ind.indicators(df, S, "close", ["sma5", "rsi14", "ema3", "atr7", "macd", "std4"]).orderBy("timestamp")
    assert set(got.columns) >= {"sma5", "rsi14", "ema3", "atr7", "macd", "signal", "histogram", "std4"}
    assert values(got, "sma5") == values(df.withColumn("s", S.sma("close", 5)), "s")
    assert values(got, "rsi14") == values(ind.rsi(df, S, "close"), "rsi")
    with pytest.raises(ValueError):
        ind.indicators(df, S, "close", ["nope3"])
    assert set(ind.indicator_set(df, S, "close").columns) >= {"sma5", "max20"}


def test_sma_of_too_few_rows_is_an_error(spark):
    df = series(spark, [1, 2, 3])
    assert values(ind.valid_sma(df, S, "close", 2), "sma") == [1.5, 2.5]
    with pytest.raises(Exception, match="fewer than 5"):
        ind.valid_sma(df, S, "close", 5).collect()


def test_smoothing_needs_one_shuffle_and_no_join(spark):
    plan = ind.macd(series(spark, range(50)), S, "close")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("span", [1, 7, 1000])
def test_long_series_in_buckets(spark, span):
    rng = random.Random(span)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(60), i, rng.choice([rng.uniform(-5, 5), None])) for i in range(400)]
    df = spark.createDataFrame(rows, "symbol string, timestamp long, id long, price double")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    keys = {"keys": ["symbol"], "order": ["timestamp", "id"]}
    assert same(ts.numbered(df, **keys), ts.numbered(df, **keys, span=span))
    whole = df.fillna(0.0, ["price"])
    a, b = (ts.prefix_sum(whole, "price", **keys, span=s).withColumn("prefix_sum", F.round("prefix_sum", 6) + 0.0) for s in (None, span))
    assert same(a, b)
    left, right = df.where("id % 3 = 0").select("symbol", "timestamp", "id"), df.where("id % 3 = 1")
    join = lambda s: ts.asof_join(left, right, by=["symbol"], ts="timestamp", values=["price"], right_unique="id", span=s)
    assert same(join(None), join(span))


def test_dialects_keep_their_tables_apart(spark):
    a, b = Dialect(spark), Dialect(spark)
    for d, v in ((a, 1), (b, 2)):
        d.sql("CREATE TABLE t (x INT, s STRING)")
        d.sql(f"INSERT INTO t VALUES ({v}, null), ({v + 5}, 'q')")
    assert [sorted(r.x for r in d.sql("SELECT x FROM t").collect()) for d in (a, b)] == [[1, 6], [2, 7]]
    got = a.sql("SELECT k.x FROM t AS k, t WHERE t.x = 1 AND k.x > t.x").collect()
    assert [r.x for r in got] == [6]
    rows = a.sql("WITH u AS (SELECT t.x AS n, s FROM t WHERE t.x IN (SELECT x FROM t)) SELECT n, s || '-' || (n + 1) || s AS y FROM u ORDER BY 1").collect()
    assert [(r.n, r.y) for r in rows] == [(1, "-2"), (6, "q-7q")]
    assert a.sql("SELECT p.x FROM t p JOIN t q ON p.x = q.x").count() == 2
    with pytest.raises(ValueError, match="ORDER BY"):
        a.sql("SELECT SUM(x) OVER (PARTITION BY s) AS y FROM t")
    a.register_function("twice", lambda x: x * 2, "int")
    assert sorted(r.y for r in a.sql("SELECT twice(x) AS y FROM t").collect()) == [2, 12]
    a.close()
    assert b.sql("SELECT * FROM t").count() == 2


def test_inverted_file_index(spark, tmp_path):
    import numpy as np

    from chronolith.operators.ann import Index

    rng = np.random.default_rng(3)
    centers = rng.normal(size=(20, 16))
    m = (centers[rng.integers(0, 20, 1500)] + 0.25 * rng.normal(size=(1500, 16))).astype("float32")
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)] + [(5000, None), (5001, [1.0])], "vec_id long, embedding array<float>")
    index = Index.build(df.where("vec_id < 1000 or vec_id >= 5000"), f"file://{tmp_path}/ivf", cells=25)
    index.insert(df.where("vec_id between 1000 and 1499"))
    index.delete(df.where("vec_id % 10 = 7"))
    assert index.rows().count() == 1350
    queries = df.where("vec_id % 50 = 0 and embedding is not null and size(embedding) = 16").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    u = m.astype(float) / np.linalg.norm(m, axis=1, keepdims=True)
    for got in (index, index.vacuum(f"file://{tmp_path}/ivf2")):
        found = {}
        for r in got.search(queries, 10, probes=5).collect():
            found.setdefault(r.query_id, set()).add(r.id)
        hits = total = 0
        for q in range(0, 1500, 50):
            best = [i for i in np.argsort(-(u @ u[q])) if i != q and i % 10 != 7][:10]
            hits, total = hits + len(found[q] & set(best)), total + 10
            assert all(i % 10 != 7 for i in found[q])
        assert hits / total >= 0.9


def test_position_marks_and_reports(spark):
    from chronolith.operators import analytics as an

    p = spark.createDataFrame([("a", "x", 100.0, 2.0, 10.0), ("a", "y", 100.0, -1.0, 5.0)], "account string, symbol string, cash double, position double, average double")
    marks = spark.createDataFrame([("x", 12.0)], "symbol string, price double")
    r = an.marked_equity(p, marks, ["account"], cash="cash", position="position", average="average").first()
    assert (r.equity, r.unrealised) == (100 + 24 - 5, 4.0)


def stream_of(spark, tmp_path, rows, files=1, extra=""):
    folder = tmp_path / "in"
    schema = "symbol string, id long, ts timestamp, price double" + extra
    import datetime

    made = [(s, i, datetime.datetime.fromtimestamp(1_700_000_000 + t), v, *rest) for s, i, t, v, *rest in rows]
    for k in range(files):
        spark.createDataFrame(made[k::files] if files == 1 else made[k * len(made) // files : (k + 1) * len(made) // files], schema).coalesce(1).write.mode("append").parquet(str(folder))
    from chronolith.streaming import file_stream

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return file_stream(spark, str(folder), spark.read.parquet(str(folder)).schema, 100)


def test_stream_orders_more_rows_than_a_batch(spark, tmp_path):
    from chronolith.streaming import run_to_table, stream_indicator

    rng = random.Random(9)
    prices = [rng.uniform(1, 9) for _ in range(25_000)]
    rows = [("x", i, i, v) for i, v in enumerate(prices)][::-1]
    got = {r.id: r for r in run_to_table(stream_indicator(stream_of(spark, tmp_path, rows), 12), f"file://{tmp_path}/out", "append").collect()}
    ema = None
    for i, v in enumerate(prices):
        ema = v if ema is None else 2 / 13 * v + 11 / 13 * ema
        assert abs(got[i].ema - ema) < 1e-9
        last = prices[max(0, i - 11) : i + 1]
        assert abs(got[i].sma - sum(last) / len(last)) < 1e-9


def test_stream_backfill_and_reset(spark, tmp_path):
    from chronolith.streaming import Ema, Macd, Rsi, run_to_table, stream_indicators

    prices = [50 + 10 * ((i * 37) % 11) / 11 for i in range(120)]
    make = lambda: [Ema(5), Rsi(7), Macd(3, 6, 4)]
    whole, want = make(), []
    for i, v in enumerate(prices):
        if i == 90:
            whole = make()
        want.append([x for f in whole for x in f.update(v)])
    stream = stream_of(spark, tmp_path, [("x", i, i, v, i == 90) for i, v in enumerate(prices) if i >= 50], extra=", reset boolean")
    import datetime

    history = spark.createDataFrame([("x", i, datetime.datetime.fromtimestamp(1_700_000_000 + i), v) for i, v in enumerate(prices[:50])][::-1], "symbol string, id long, ts timestamp, price double")
    got = {r.id: r for r in run_to_table(stream_indicators(stream, make, history=history), f"file://{tmp_path}/out", "append").collect()}
    assert set(got) == set(range(50, 120))
    for i, r in got.items():
        assert [r.ema, r.rsi, r.macd, r.signal, r.histogram] == pytest.approx(want[i])


def test_upsert_sink_and_late_rows(spark, tmp_path):
    from chronolith.streaming import run_to_table, stream_bars, upsert_sink

    kept = []
    upsert_sink(lambda b: kept.extend(map(tuple, b.collect())), ["k"], "at")(spark.createDataFrame([(1, "a", 1), (1, "b", 3), (2, "c", 2)], "k int, v string, at int"), 0)
    assert sorted(kept) == [(1, "b", 3), (2, "c", 2)]
    stream = stream_of(spark, tmp_path, [("x", i, 60 * i, float(i)) for i in range(60)]).withColumn("volume", F.lit(1.0))
    bars = run_to_table(stream_bars(stream, "10 minutes", "5 minutes", slide="5 minutes"), f"file://{tmp_path}/out", "complete").orderBy("bar_start").collect()
    assert len(bars) >= 12 and sum(b.n for b in bars) == 120  # each row is in two windows


def _searched(m, ids, queries, allowed, k):
    """Brute force for a search: (query, id) to similarity, with the exact cosine of the operators."""
    want = {}
    for q in queries:
        near = []
        for i, v in zip(ids, m):
            if i != ids[q] and allowed(q, i):
                dot = [functools.reduce(lambda s, x: s + x, (float(x) * float(y) for x, y in zip(a, b)), 0.0) for a, b in ((m[q], v), (m[q], m[q]), (v, v))]
                norm = math.sqrt(dot[1]) * math.sqrt(dot[2])
                near.append((-(dot[0] / norm if norm > 0 else 0.0), i))
        want |= {(ids[q], i): -s for s, i in sorted(near)[:k]}
    return want


def test_lsh_search_by_blocks(spark, monkeypatch):
    import numpy as np

    from chronolith.operators import vectors

    rng = np.random.default_rng(8)
    m = np.concatenate([rng.normal(size=(150, 8)), np.tile(rng.normal(size=8), (30, 1)), np.zeros((3, 8))]).astype("float32")
    ids = [int(i) for i in rng.permutation(len(m))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m)], "vec_id long, embedding array<float>")
    bucket = (np.einsum("nd,tbd->ntb", m.astype(float), vectors.planes(8, 6, 3)) > 0) @ (1 << np.arange(3))
    at = {i: p for p, i in enumerate(ids)}
    want = _searched(m, ids, [p for p, i in enumerate(ids) if i % 9 == 0], lambda q, i: (bucket[q] == bucket[at[i]]).any(), 7)
    for asked, rows in ((4096, 8192), (5, 16)):
        monkeypatch.setattr(vectors, "SEARCH_ASKED", asked)
        monkeypatch.setattr(vectors, "SEARCH_ROWS", rows)
        found = vectors.lsh_search(df, df.where("vec_id % 9 = 0"), 7, dim=8, tables=6, bits=3)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan  # no row for each pair that shares a bucket
        assert {(r.query_id, r.id): r.similarity for r in found.collect()} == want


def test_index_search_by_blocks(spark, tmp_path, monkeypatch):
    import numpy as np

    from chronolith.operators import ann, vectors

    rng = np.random.default_rng(4)
    m = np.concatenate([rng.normal(size=(150, 8)), np.tile(rng.normal(size=8), (30, 1))]).astype("float32")
    ids = [int(i) for i in rng.permutation(len(m))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, m)], "vec_id long, embedding array<float>")
    index = ann.Index.build(df, f"file://{tmp_path}/ivf", cells=12)
    cell = {r.vec_id: r.cell for r in index.rows().collect()}
    near = lambda q: np.argsort(-(index.centers @ m[q].astype(float)), kind="stable")[:5]
    want = _searched(m, ids, [p for p, i in enumerate(ids) if i % 9 == 0], lambda q, i: cell[i] in near(q), 7)
    queries = df.where("vec_id % 9 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    for asked, rows in ((4096, 8192), (5, 16)):
        monkeypatch.setattr(vectors, "SEARCH_ASKED", asked)
        monkeypatch.setattr(vectors, "SEARCH_ROWS", rows)
        found = index.search(queries, 7, probes=5)
        assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # no row for each query and cell
        assert {(r.query_id, r.id): r.similarity for r in found.collect()} == want
    one = index.search(queries.limit(1), 7, probes=5)._jdf.queryExecution().optimizedPlan().toString()
    assert "cell" in one and " IN (" in one  # only the probed cells are read


def test_stream_rows_are_ordered_in_bounded_memory(monkeypatch):
    import tracemalloc

    import numpy as np
    import pandas as pd

    from chronolith.streaming import streams

    for name, n in (("RUN_ROWS", 10_000), ("MERGE_ROWS", 500), ("FAN_IN", 4), ("OUT_ROWS", 900)):
        monkeypatch.setattr(streams, name, n)
    rng = np.random.default_rng(2)

    def frames(n):
        for at in range(0, n, 3000):
            times = pd.Series(pd.to_datetime(rng.integers(0, 5000, 3000), unit="s"))
            yield pd.DataFrame({"symbol": "x", "ts": times.mask(times.index % 991 == 5), "id": rng.integers(0, 9, 3000), "price": np.arange(at, at + 3000, dtype=float), "reset": [None, True, False] * 1000})

    fed = list(frames(120_000))
    fed[3]["id"] = fed[3]["id"].astype(float).mask(fed[3].index % 7 == 0)
    want = pd.concat(fed).sort_values(["ts", "id"], kind="stable")
    got = list(streams.in_order(iter(fed)))
    assert max(map(len, got)) <= 900
    got = pd.concat([g.astype({"id": "Int64"}) for g in got])
    assert got["price"].tolist() == want["price"].tolist() and got["reset"].tolist() == want["reset"].fillna(False).tolist()
    assert got["id"].isna().tolist() == want["id"].isna().tolist() and got["id"].fillna(-1).tolist() == want["id"].fillna(-1).tolist()
    small = pd.DataFrame({"ts": [2.5, -1.0, None, 2.25, -3.5], "id": range(5), "price": range(5)})
    assert pd.concat(streams.in_order(iter([small])))["id"].tolist() == [4, 1, 3, 0, 2]
    assert list(streams.in_order(iter([]))) == []
    peaks = []
    for n in (60_000, 480_000):
        tracemalloc.start()
        assert sum(map(len, streams.in_order(frames(n)))) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.5 * peaks[0]  # eight times the rows


def test_positions_stream_through_batches(spark):
    from chronolith.operators.analytics import positions

    rng = random.Random(6)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice(["buy", "sell"]), rng.uniform(1, 9), float(rng.randint(0, 3))) for i in range(900)] + [(f"k{i}", i, "sell", 2.0, 1.0) for i in range(300)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, id long, side string, price double, qty double")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = positions(df.withColumn("made", F.array("price")), ["k"], "id")
        assert "FlatMapGroups" not in found._jdf.queryExecution().optimizedPlan().toString()  # no frame for each key
        got = {(r.k, r.id): r for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    held, want = {}, {}
    for k, i, side, price, qty in sorted(rows, key=lambda r: r[1]):
        pos, avg = held.get(k, (0.0, 0.0))
        q, gain = (qty if side == "buy" else -qty), 0.0
        if pos * q >= 0:
            avg = (avg * abs(pos) + price * abs(q)) / (abs(pos) + abs(q)) if q else avg
        else:
            gain = min(abs(pos), abs(q)) * (price - avg) * (1 if pos > 0 else -1)
            avg = price if abs(q) > abs(pos) else 0.0 if abs(q) == abs(pos) else avg
        held[k] = pos + q, avg
        want[k, i] = (pos + q, avg, gain)
    assert {x: (r.position, r.avg_price, r.realised) for x, r in got.items()} == want
    assert all(r.made == [r.price] for r in got.values())


def test_similar_pairs_send_blocks_and_pairs_seldom(spark):
    from chronolith.operators import vectors

    df = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.cos(F.col("id") * 0.1), F.sin(F.col("id") * 0.1)).alias("embedding"))
    pairs = vectors.similar_pairs(df, 0.99)
    assert "Join" not in pairs._jdf.queryExecution().optimizedPlan().toString()  # no pair is shuffled if no vectors are equal
    assert pairs.count() == sum(math.cos((j - i) * 0.1) >= 0.99 for i in range(300) for j in range(i + 1, 300))
    for n in (100_000, 600_000, 1_000_000):  # a block is sent to each other block
        assert n / vectors._block_rows(n, 64) <= 31 and vectors._block_rows(n, 64) * 64 <= vectors.BLOCK_VALUES


def test_embeddings_are_held_as_numbers(spark):
    import tracemalloc

    import pyarrow as pa

    from chronolith.operators import vectors

    texts = pa.array([f"the fox {i} of {i % 7} 日本 " * 5 for i in range(4000)] + [None, ""])
    tracemalloc.start()
    made = vectors._embedded(texts, 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * len(texts) * 64 * 8  # lists of Python numbers take four times as much
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts.to_pylist())], "id int, t string").coalesce(1)
    got = [r[0] for r in df.select("id", vectors.hash_embedding(F.col("t")).alias("e")).orderBy("id").select("e").collect()]
    assert got == made.to_pylist() and got[-2:] == [[0.0] * 64] * 2
