"""Every query with SQL against DuckDB on the smallest test tables."""

import math
import os

import duckdb
import pytest

from chronolith import catalog

SF = "/root/testdata/sf0.001"
TABLES = [f[:-8] for f in sorted(os.listdir(SF)) if f.endswith(".parquet")] if os.path.isdir(SF) else []


def norm(v):
    if v is None:
        return None
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return v.isoformat() if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(catalog.SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want


@pytest.mark.parametrize("name", ["ann_lsh", "ann_ivf"])
def test_ann_recall(spark, sf, name):
    import numpy as np

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = e.collect()
    m = np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = np.array([r.vec_id for r in rows])
    found = {}
    for r in catalog.QUERIES[name](spark, sf).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    hits = total = 0
    for q in ids[ids % 50 == 0]:
        s = m @ m[np.flatnonzero(ids == q)[0]]
        best = [ids[i] for i in np.argsort(-s) if ids[i] != q][:10]
        hits += len(found.get(q, set()) & set(best))
        total += 10
    assert hits / total >= 0.9


def test_positions(spark):
    from chronolith.operators.analytics import positions

    rows = [("a", 1, "buy", 10.0, 2.0), ("a", 2, "buy", 20.0, 2.0), ("a", 3, "sell", 30.0, 3.0), ("a", 4, "sell", 10.0, 3.0)]
    got = positions(spark.createDataFrame(rows, "k string, id long, side string, price double, qty double"), ["k"], "id").orderBy("id").collect()
    assert [(r.position, r.avg_price, r.realised) for r in got] == [(2, 10, 0), (4, 15, 0), (1, 15, 45), (-2, 10, -5)]


def test_stream_ema_equals_batch(spark):
    got = {r.id: r.ema for r in catalog.QUERIES["stream_ema"](spark, SF).collect()}
    ema, want = {}, {}
    for r in catalog.ticks(spark, SF).orderBy("timestamp", "id").collect():
        p = ema.get(r.symbol)
        ema[r.symbol] = r.price if p is None else 2 / 13 * r.price + 11 / 13 * p
        want[r.id] = ema[r.symbol]
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-9 for k in want)
