"""The library's operators as named queries over the test tables, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolith import functions as X
from chronolith import schemas
from chronolith.operators import analytics as an
from chronolith.operators import ann
from chronolith.operators import data_quality as dq
from chronolith.operators import facts as fa
from chronolith.operators import indicators as ind
from chronolith.operators import mutations as mut
from chronolith.operators import scans
from chronolith.operators import timeseries as ts
from chronolith.operators import vectors as vec
from chronolith.plans import Dialect
from chronolith.session import work_path
from chronolith.sources import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its own name."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = " ".join(sql.split())
        return f

    return put


# Views that the queries share, in both forms.
TICKS = "ticks AS (SELECT event_id AS id, event_type AS symbol, user_id, epoch_us(ts) // 1000 AS timestamp, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)"
BARS = TICKS + ", bars AS (SELECT symbol, '1h' AS interval, timestamp - timestamp % 3600000 AS timestamp, arg_min(price, timestamp) AS open, max(price) AS high, min(price) AS low, arg_max(price, timestamp) AS close, sum(volume) AS volume FROM ticks GROUP BY symbol, timestamp - timestamp % 3600000)"
#: Fixed literals of the vector queries: eight values, repeated to the dimension.
PROBE = [0.3, -0.2, 0.5, 0.1, -0.4, 0.2, 0.05, -0.1]
DIM = 64  # of the test vectors
S = ind.Series(["symbol"], ["timestamp"])
DAY = 86_400_000  # milliseconds: the time buckets that long series are cut into


def ticks(spark: SparkSession, d: str) -> DataFrame:
    e = read_table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), "user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), F.col("value").alias("price"), k.alias("volume"))


def bars(spark: SparkSession, d: str) -> DataFrame:
    b = ts.ohlcv(ticks(spark, d), "1h", keys=["symbol"], unique="id")
    return b.select("symbol", F.lit("1h").alias("interval"), "timestamp", "open", "high", "low", "close", "volume")


def r(c, n: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# --- filters and projections -------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000 AND o_orderstatus <> 'F'")
def filter_compare(spark, d):
    return read_table(spark, d, "orders").where((F.col("o_totalprice") > 300000) & (F.col("o_orderstatus") != "F")).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED_W%'")
def filter_like_ci(spark, d):
    return read_table(spark, d, "part").where(F.col("p_name").ilike("%RED_W%")).select("p_partkey", "p_name")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'view')")
def filter_in_list(spark, d):
    return read_table(spark, d, "events").where(F.col("event_type").isin("click", "view")).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE (event_type, user_id) IN (('click', 13), ('view', 7), ('error', 8))")
def filter_tuple_in(spark, d):
    return scans.tuple_in(read_table(spark, d, "events"), ["event_type", "user_id"], [("click", 13), ("view", 7), ("error", 8)]).select("event_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
def filter_between(spark, d):
    return read_table(spark, d, "lineitem").where(F.col("l_quantity").between(10, 12)).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 100000) AND o_orderpriority = '5-LOW'")
def filter_not_or(spark, d):
    f = ~((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") < 100000)) & (F.col("o_orderpriority") == "5-LOW")
    return read_table(spark, d, "orders").where(f).select("o_orderkey")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
def filter_is_null(spark, d):
    c, o = read_table(spark, d, "customer"), read_table(spark, d, "orders").where("o_totalprice > 400000")
    return c.join(o, c.c_custkey == o.o_custkey, "left").where(o.o_orderkey.isNull()).select("c_custkey", "o_orderkey")


@query(
    """SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge, round(sqrt(l_quantity), 6) AS root,
    round(ln(l_extendedprice), 6) AS natural_log, floor(l_extendedprice * 10 + 0.5) / 10 AS tenths, l_quantity % 7 AS remainder, sign(l_discount - 0.05) AS side FROM lineitem"""
)
def scalar_math(spark, d):
    p = F.col("l_extendedprice")
    return read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", r(p * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 6).alias("charge"), r(F.sqrt("l_quantity")).alias("root"), r(F.ln(p)).alias("natural_log"),
        X.round_half_up(p, 1).alias("tenths"), (F.col("l_quantity") % 7).alias("remainder"), F.signum(F.col("l_discount") - 0.05).alias("side"),
    )


@query("SELECT p_partkey, length(p_name) AS n, upper(p_name) AS up, replace(p_brand, '#', '-') AS brand, substr(p_type, 2, 3) AS part, coalesce(p_name, '') || '/' || coalesce(p_brand, '') AS label FROM part")
def scalar_string(spark, d):
    return read_table(spark, d, "part").select(
        "p_partkey", F.length("p_name").cast("long").alias("n"), F.upper("p_name").alias("up"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("brand"), F.substring("p_type", 2, 3).alias("part"), X.null_concat(F.col("p_name"), F.lit("/"), F.col("p_brand")).alias("label")
    )


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END AS size, nullif(o_orderstatus, 'P') AS status, coalesce(nullif(o_orderstatus, 'P'), '?') AS shown, least(o_totalprice, 100000.0) AS low, greatest(o_totalprice, 100000.0) AS high FROM orders")
def scalar_conditional(spark, d):
    s = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return read_table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") > 200000, "big").otherwise("small").alias("size"), s.alias("status"), F.coalesce(s, F.lit("?")).alias("shown"), F.least("o_totalprice", F.lit(100000.0)).alias("low"), F.greatest("o_totalprice", F.lit(100000.0)).alias("high")
    )


@query(f"WITH {TICKS} SELECT strftime(epoch_ms(timestamp), '%Y-%m-%d %H') AS hour, count(*) AS n FROM ticks GROUP BY 1")
def scalar_strftime(spark, d):
    return ticks(spark, d).groupBy(X.strftime(F.col("timestamp"), "%Y-%m-%d %H").alias("hour")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, CAST(floor(l_quantity) AS INTEGER) AS q, CAST(l_orderkey AS VARCHAR) AS k, CAST(l_linenumber AS DOUBLE) AS x FROM lineitem")
def cast_types(spark, d):
    return read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.floor("l_quantity").cast("int").alias("q"), F.col("l_orderkey").cast("string").alias("k"), F.col("l_linenumber").cast("double").alias("x"))


@query(f"WITH {BARS} SELECT symbol, timestamp, close FROM bars WHERE symbol IN ('click', 'error') AND timestamp >= 1704240000000 AND timestamp <= 1704412800000")
def scan_series_range(spark, d):
    return scans.scan(bars(spark, d), symbols=["click", "error"], interval="1h", start=1704240000000, end=1704412800000).select("symbol", "timestamp", "close")


@query(f"WITH {TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp, id) AS rn FROM ticks) SELECT symbol, id FROM n WHERE rn > 5 AND rn <= 12")
def slice_rows(spark, d):
    return scans.slice_rows(ticks(spark, d), 5, 12, keys=["symbol"], order=["timestamp", "id"]).select("symbol", "id")


@query("SELECT DISTINCT event_type, user_id FROM events")
def list_series(spark, d):
    return scans.list_series(read_table(spark, d, "events"), ["event_type", "user_id"])


@query(f"WITH {TICKS} SELECT coalesce(max(timestamp), -1) AS latest FROM ticks WHERE symbol = 'click'")
def latest_timestamp(spark, d):
    return scans.latest_timestamp(ticks(spark, d).where("symbol = 'click'"))


# --- joins -------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def join_inner(spark, d):
    o, c = read_table(spark, d, "orders"), read_table(spark, d, "customer").where("c_mktsegment = 'BUILDING'")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def join_left(spark, d):
    c, o = read_table(spark, d, "customer"), read_table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return c.join(o, c.c_custkey == o.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    """SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' GROUP BY r_name, n_name"""
)
def join_multiway(spark, d):
    t = {x: read_table(spark, d, x) for x in ("lineitem", "orders", "customer", "nation", "region")}
    o = t["orders"].where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    j = t["lineitem"].join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
    j = j.join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name").agg(r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_in_subquery(spark, d):
    c, o = read_table(spark, d, "customer"), read_table(spark, d, "orders").where("o_totalprice > 400000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def anti_not_in(spark, d):
    c, o = read_table(spark, d, "customer"), read_table(spark, d, "orders").where("o_totalprice > 400000")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


@query(
    f"""WITH {TICKS} SELECT c.id, c.user_id, c.timestamp, c.price, v.price AS r_price FROM (SELECT * FROM ticks WHERE symbol = 'click') c
    ASOF LEFT JOIN (SELECT * FROM ticks WHERE symbol = 'view') v ON c.user_id = v.user_id AND c.timestamp >= v.timestamp"""
)
def asof_join(spark, d):
    t = ticks(spark, d)
    click = t.where("symbol = 'click'").select("id", "user_id", "timestamp", "price")
    return ts.asof_join(click, t.where("symbol = 'view'"), by=["user_id"], ts="timestamp", values=["price"], right_unique="id", span=DAY)


@query(f"WITH {TICKS} SELECT s.symbol, coalesce(arg_max(t.price, t.timestamp), 0) AS price, coalesce(arg_max(t.volume, t.timestamp), 0) AS volume FROM (SELECT DISTINCT symbol FROM ticks) s LEFT JOIN ticks t ON t.symbol = s.symbol AND t.timestamp <= 1705000000000 GROUP BY s.symbol")
def asof_snapshot(spark, d):
    return ts.asof_snapshot(ticks(spark, d), 1705000000000)


@query(f"WITH {TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY abs(timestamp - 1705000000000), timestamp DESC, id) AS k FROM ticks) SELECT symbol, id, timestamp, price FROM n WHERE k = 1")
def nearest_time(spark, d):
    return ts.nearest_time(ticks(spark, d).select("symbol", "id", "timestamp", "price"), 1705000000000, keys=["symbol"])


@query(f"WITH {TICKS}, q AS (SELECT DISTINCT symbol, 1704067200000 + k * 86400000 AS target FROM ticks, range(0, 30) AS x(k)) SELECT q.symbol, q.target, count(t.id) AS index FROM q LEFT JOIN ticks t ON t.symbol = q.symbol AND t.timestamp < q.target GROUP BY q.symbol, q.target")
def lower_bound_index(spark, d):
    t = ticks(spark, d)
    days = F.explode(F.sequence(F.lit(1704067200000), F.lit(1704067200000 + 29 * 86400000), F.lit(86400000)))
    got = ts.first_index_at_or_after(t, t.select("symbol").distinct().select("symbol", days.alias("target")), keys=["symbol"])
    return got.select("symbol", "target", F.col("index").cast("long").alias("index"))


@query("SELECT a.vec_id AS id_a, b.vec_id AS id_b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4")
def sim_self_join(spark, d):
    return vec.similar_pairs(read_table(spark, d, "embeddings"), 0.4).select("id_a", "id_b")


# --- aggregates --------------------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, round(sum(l_quantity), 4) AS total, round(avg(l_extendedprice), 4) AS mean, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem")
def agg_global(spark, d):
    return read_table(spark, d, "lineitem").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 4).alias("total"), r(F.avg("l_extendedprice"), 4).alias("mean"), F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def agg_group(spark, d):
    return read_table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY l_returnflag, l_linestatus")
def agg_group_multi(spark, d):
    return read_table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), r(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), r(F.avg("l_discount")).alias("discount")
    )


@query("SELECT l_suppkey, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_suppkey HAVING count(*) > 600 AND avg(l_quantity) > 25")
def agg_having(spark, d):
    g = read_table(spark, d, "lineitem").groupBy("l_suppkey").agg(r(F.sum("l_quantity"), 2).alias("quantity"), F.count("*").alias("n"), F.avg("l_quantity").alias("a"))
    return g.where("n > 600 and a > 25").select("l_suppkey", "quantity")


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def agg_count_distinct(spark, d):
    return read_table(spark, d, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))


@query("SELECT user_id, round(coalesce(stddev_samp(value), 0), 6) AS deviation, round(coalesce(var_samp(value), 0), 6) AS variance FROM events GROUP BY user_id")
def agg_var_std(spark, d):
    return read_table(spark, d, "events").groupBy("user_id").agg(r(X.sample_std(F.col("value"))).alias("deviation"), r(X.sample_var(F.col("value"))).alias("variance"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def agg_percentile(spark, d):
    return read_table(spark, d, "events").groupBy("event_type").agg(r(F.percentile("value", F.lit(0.5))).alias("p50"), r(F.percentile("value", F.lit(0.95))).alias("p95"))


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS c FROM lineitem GROUP BY l_returnflag")
def agg_corr(spark, d):
    return read_table(spark, d, "lineitem").groupBy("l_returnflag").agg(r(F.corr("l_quantity", "l_extendedprice")).alias("c"))


@query(f"WITH {TICKS} SELECT symbol, arg_min(price, timestamp) AS first_price, arg_max(price, timestamp) AS last_price FROM ticks GROUP BY symbol")
def agg_first_last(spark, d):
    o = F.struct("timestamp", "id")
    return ticks(spark, d).groupBy("symbol").agg(F.min_by("price", o).alias("first_price"), F.max_by("price", o).alias("last_price"))


@query("SELECT year(o_orderdate) AS y, max(o_totalprice) AS top FROM orders GROUP BY 1")
def partition_max(spark, d):
    return read_table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.max("o_totalprice").alias("top"))


@query(f"WITH {BARS} SELECT symbol, count(*) AS count, min(timestamp) AS earliest, max(timestamp) AS latest, round(avg(close), 6) AS avg_price, min(low) AS min_price, max(high) AS max_price FROM bars GROUP BY symbol")
def symbol_stats(spark, d):
    return scans.symbol_stats(bars(spark, d), ["symbol"]).withColumn("avg_price", r("avg_price"))


@query("SELECT event_type, user_id, count(*) AS n FROM events GROUP BY event_type, user_id")
def series_count(spark, d):
    return read_table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))


@query(f"WITH {BARS}, x AS (SELECT CASE WHEN timestamp % 7 = 0 THEN -1 ELSE volume END AS volume FROM bars) SELECT count(*) AS total_rows, count(*) FILTER (volume >= 0) AS valid_rows, count(*) FILTER (volume < 0) AS tombstones FROM x")
def table_info(spark, d):
    return scans.table_info(bars(spark, d).withColumn("volume", F.when(F.col("timestamp") % 7 == 0, -1.0).otherwise(F.col("volume"))))


# --- windows -----------------------------------------------------------------------------------------------------

def _w():
    return Window.partitionBy("symbol").orderBy("timestamp", "id")


def _run():
    return _w().rowsBetween(Window.unboundedPreceding, 0)



def _window(name: str, column: Callable[[], F.Column], sql: str) -> None:
    def f(spark, d, column=column):
        return ticks(spark, d).select("id", "symbol", column().alias("x"))

    f.__name__ = name
    query(f"WITH {TICKS} SELECT id, symbol, {sql} AS x FROM ticks")(f)


_OVER = "OVER (PARTITION BY symbol ORDER BY timestamp, id {})"
_window("win_row_number", lambda: F.row_number().over(_w()).cast("long"), "row_number() " + _OVER.format(""))
_window("win_lag_lead", lambda: F.lead("price", 2).over(_w()) - F.lag("price").over(_w()), f"lead(price, 2) {_OVER.format('')} - lag(price) {_OVER.format('')}")
_window("win_running_sum", lambda: r(F.sum("price").over(_run()), 4), f"round(sum(price) {_OVER.format('ROWS UNBOUNDED PRECEDING')}, 4)")
_window("win_running_count", lambda: F.count("*").over(_run()), f"count(*) {_OVER.format('ROWS UNBOUNDED PRECEDING')}")
_window("win_rolling_avg", lambda: r(F.avg("price").over(_w().rowsBetween(-9, 0))), f"round(avg(price) {_OVER.format('ROWS BETWEEN 9 PRECEDING AND CURRENT ROW')}, 6)")
_window("win_rolling_minmax", lambda: F.max("price").over(_w().rowsBetween(-9, 0)) - F.min("price").over(_w().rowsBetween(-9, 0)), f"max(price) {_OVER.format('ROWS BETWEEN 9 PRECEDING AND CURRENT ROW')} - min(price) {_OVER.format('ROWS BETWEEN 9 PRECEDING AND CURRENT ROW')}")
_window("win_rolling_std", lambda: r(F.coalesce(F.stddev_samp("price").over(_w().rowsBetween(-9, 0)), F.lit(0.0)), 5), f"round(coalesce(stddev_samp(price) {_OVER.format('ROWS BETWEEN 9 PRECEDING AND CURRENT ROW')}, 0), 5)")
_window("win_in_expr", lambda: r(F.col("price") / F.nullif(F.max("price").over(_run()), F.lit(0.0)) * 100, 5), f"round(price / nullif(max(price) {_OVER.format('ROWS UNBOUNDED PRECEDING')}, 0) * 100, 5)")


@query(f"WITH {TICKS} SELECT id, rank() OVER (PARTITION BY symbol ORDER BY volume) AS x FROM ticks")
def win_rank(spark, d):
    return ticks(spark, d).select("id", F.rank().over(Window.partitionBy("symbol").orderBy("volume")).cast("long").alias("x"))


@query(f"WITH {TICKS} SELECT symbol, user_id, arg_max(price, timestamp) AS price, max(timestamp) AS timestamp FROM ticks GROUP BY symbol, user_id")
def latest_per_group(spark, d):
    return ts.latest_on(ticks(spark, d), keys=["symbol", "user_id"], order=["timestamp", "id"]).select("symbol", "user_id", "price", "timestamp")


# --- sorting, limits, sets, composition --------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 500")
def order_multi(spark, d):
    return read_table(spark, d, "orders").orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(500).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_extendedprice / l_quantity DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def order_expr(spark, d):
    return read_table(spark, d, "lineitem").orderBy(F.desc(F.col("l_extendedprice") / F.col("l_quantity")), "l_orderkey", "l_linenumber", "l_partkey").limit(100).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")
def limit_offset(spark, d):
    return read_table(spark, d, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").offset(10).limit(20)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk(spark, d):
    return read_table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def distinct(spark, d):
    return read_table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def union_partitions(spark, d):
    o = read_table(spark, d, "orders")
    part = lambda s: o.where(F.col("o_orderstatus") == s).select("o_orderkey", "o_totalprice")
    return part("F").unionByName(part("O"))


@query("WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT c_mktsegment, sum(n)::BIGINT AS orders FROM per JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def cte_chain(spark, d):
    dialect = Dialect(spark)
    for name in ("orders", "customer"):
        dialect.register(name, read_table(spark, d, name))
    return dialect.sql(
        "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 200000), per AS (SELECT o_custkey, COUNT(*) AS n FROM big GROUP BY o_custkey) SELECT c_mktsegment, SUM(n) AS orders FROM per JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment"
    )


@query("SELECT x.brand, x.n FROM (SELECT p_brand AS brand, count(*) AS n FROM part GROUP BY p_brand) AS x WHERE x.n > 5")
def derived_table(spark, d):
    dialect = Dialect(spark)
    dialect.register("part", read_table(spark, d, "part"))
    return dialect.sql("SELECT x.brand, x.n FROM (SELECT p_brand AS brand, COUNT(*) AS n FROM part GROUP BY p_brand) AS x WHERE x.n > 5")


@query(f"WITH {TICKS} SELECT id, round(sum(price) OVER (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING), 4) AS running FROM ticks WHERE symbol ILIKE 'C%'")
def dialect_running_window(spark, d):
    dialect = Dialect(spark)
    dialect.register("ticks", ticks(spark, d))
    t = dialect.sql("SELECT id, SUM(price) OVER (PARTITION BY symbol ORDER BY timestamp) AS running FROM ticks WHERE symbol LIKE 'C%'")
    return t.withColumn("running", r("running", 4))


@query("SELECT o_orderpriority AS p, round(quantile_cont(o_totalprice, 0.9), 4) AS p90, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS s, count(*) AS n FROM orders GROUP BY 1")
def dialect_aggregates(spark, d):
    dialect = Dialect(spark)
    dialect.register("orders", read_table(spark, d, "orders"))
    t = dialect.sql("SELECT o_orderpriority AS p, PERCENTILE(o_totalprice, 90) AS p90, STDDEV(o_totalprice) AS s, COUNT(*) AS n FROM orders GROUP BY o_orderpriority")
    return t.withColumns({"p90": r("p90", 4), "s": r("s", 4)})


# --- time series -------------------------------------------------------------------------------------------------


@query(f"WITH {TICKS} SELECT symbol, timestamp - timestamp % 300000 AS timestamp, arg_min(price, timestamp) AS price_first, max(price) AS price_max, count(price) AS price_count, round(sum(volume), 4) AS volume FROM ticks GROUP BY 1, 2")
def sample_by(spark, d):
    return ts.sample_by(ticks(spark, d), "5m", {"price": ["first", "max", "count"], "volume": ["sum"]}, keys=["symbol"], unique="id").withColumn("volume", r("volume", 4))


@query(f"WITH {BARS} SELECT symbol, timestamp, open, high, low, close, volume FROM bars")
def ohlcv_1h(spark, d):
    return bars(spark, d).drop("interval")


@query(
    f"""WITH {TICKS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp, id) AS rn FROM ticks)
    SELECT symbol, (rn - 1) // 50 AS bar, arg_min(price, rn) AS open, max(price) AS high, min(price) AS low, arg_max(price, rn) AS close, sum(volume) AS volume FROM n GROUP BY 1, 2"""
)
def ohlcv_rows(spark, d):
    return ts.bars_by_rows(ticks(spark, d), 50, keys=["symbol"], order=["timestamp", "id"], span=DAY)


@query(
    f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY timestamp) AS rn FROM bars WHERE volume >= 0)
    SELECT symbol, min(timestamp) AS timestamp, arg_min(open, rn) AS open, max(high) AS high, min(low) AS low, arg_max(close, rn) AS close, sum(volume) AS volume FROM n GROUP BY symbol, (rn - 1) // 5"""
)
def resample_5(spark, d):
    return ts.resample(bars(spark, d), 5, keys=["symbol"], span=7 * DAY)


@query(f"WITH {TICKS} SELECT symbol, arg_max(id, timestamp) AS id, max(timestamp) AS timestamp FROM ticks GROUP BY symbol")
def latest_on(spark, d):
    return ts.latest_on(ticks(spark, d), keys=["symbol"], order=["timestamp", "id"]).select("symbol", "id", "timestamp")


def _ends(name: str, desc: str) -> None:
    def f(spark, d):
        o = [F.desc("timestamp"), F.desc("id")] if desc else ["timestamp", "id"]
        return ts.head_n(ticks(spark, d), 7, keys=["symbol"], order=o).select("symbol", "id", "timestamp")

    f.__name__ = name
    query(f"WITH {TICKS} SELECT symbol, id, timestamp FROM ticks QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY timestamp {desc}, id {desc}) <= 7")(f)


_ends("head_n", "")
_ends("tail_n", "DESC")


@query(f"WITH {TICKS} SELECT timestamp, symbol, id, price FROM ticks WHERE timestamp BETWEEN 1704240000000 AND 1704499200000 ORDER BY timestamp, symbol, id")
def replay_ticks(spark, d):
    t = scans.scan(ticks(spark, d), start=1704240000000, end=1704499200000)
    return ts.replay_ticks(t.select("timestamp", "symbol", "id", "price"))


@query(f"WITH {TICKS} SELECT timestamp, symbol, arg_max(price, id) AS price, arg_max(volume, id) AS volume, count(*) AS ticks FROM ticks GROUP BY timestamp, symbol")
def replay_snapshots_sparse(spark, d):
    return ts.replay_changes(ticks(spark, d))


_DENSE = f"""WITH {TICKS}, b AS (SELECT *, timestamp - timestamp % 3600000 AS b FROM ticks), g AS (SELECT DISTINCT b.b, s.symbol FROM b, (VALUES ('click'), ('view'), ('error')) s(symbol)),
h AS (SELECT b, symbol, arg_max(price, timestamp) AS price, arg_max(volume, timestamp) AS volume FROM b GROUP BY 1, 2)
SELECT g.b AS timestamp, g.symbol, coalesce(last_value(h.price IGNORE NULLS) OVER w, 0) AS price, coalesce(last_value(h.volume IGNORE NULLS) OVER w, 0) AS volume
FROM g LEFT JOIN h ON h.b = g.b AND h.symbol = g.symbol WINDOW w AS (PARTITION BY g.symbol ORDER BY g.b ROWS UNBOUNDED PRECEDING)"""


@query(_DENSE)
def replay_snapshots_dense(spark, d):
    return ts.replay_dense(ticks(spark, d), "1h", ["click", "view", "error"])


@query(f"SELECT * FROM ({_DENSE}) WHERE timestamp >= 1705000000000")
def replay_from(spark, d):
    return ts.replay_dense(ticks(spark, d), "1h", ["click", "view", "error"]).where("timestamp >= 1705000000000")


@query(f"WITH {TICKS} SELECT timestamp, count(*) AS n FROM ticks GROUP BY timestamp")
def snapshot_boundaries(spark, d):
    return ts.snapshot_boundaries(ticks(spark, d))


@query(f"WITH {TICKS} SELECT id, round(sum(price) OVER (PARTITION BY symbol ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING), 4) AS prefix_sum FROM ticks")
def prefix_sum(spark, d):
    return ts.prefix_sum(ticks(spark, d), "price", keys=["symbol"], order=["timestamp", "id"], span=DAY).select("id", r("prefix_sum", 4).alias("prefix_sum"))


@query(f"WITH {TICKS} SELECT id, coalesce(timestamp - lag(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp, id), timestamp) AS delta FROM ticks")
def delta_encode(spark, d):
    return ts.delta_encode(ticks(spark, d), "timestamp", keys=["symbol"], order=["timestamp", "id"]).select("id", "delta")


# --- indicators --------------------------------------------------------------------------------------------------

_B = "OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
_N = "row_number() OVER (PARTITION BY symbol ORDER BY timestamp)"


def _indicator(name: str, columns: Callable[[], dict], sql: dict[str, str]) -> None:
    def f(spark, d):
        return bars(spark, d).select("symbol", "timestamp", *[r(c).alias(k) for k, c in columns().items()])

    f.__name__ = name
    query(f"WITH {BARS} SELECT symbol, timestamp, {', '.join(f'round({v}, 6) AS {k}' for k, v in sql.items())} FROM bars")(f)


_full = lambda n, x: f"CASE WHEN {_N} >= {n} THEN {x} END"
_indicator("sma", lambda: {"sma": S.sma("close", 20)}, {"sma": _full(20, f"avg(close) {_B.format(19)}")})
_indicator("sma_expanding", lambda: {"sma": S.sma("close", 20, "expanding")}, {"sma": f"avg(close) {_B.format(19)}"})
_indicator("wma", lambda: {"wma": S.wma("close", 4)}, {"wma": "(" + " + ".join(f"{4 - k} * lag(close, {k}) OVER (PARTITION BY symbol ORDER BY timestamp)" for k in range(4)) + ") / 10.0"})
_indicator("momentum", lambda: {"momentum": S.momentum("close", 5)}, {"momentum": "close - lag(close, 5) OVER (PARTITION BY symbol ORDER BY timestamp)"})
_indicator("roc", lambda: {"roc": S.roc("close", 5)}, {"roc": "(close - lag(close, 5) OVER (PARTITION BY symbol ORDER BY timestamp)) / nullif(lag(close, 5) OVER (PARTITION BY symbol ORDER BY timestamp), 0) * 100"})
_indicator("rolling_std_pop", lambda: {"std": S.std("close", 20)}, {"std": _full(20, f"stddev_pop(close) {_B.format(19)}")})
_indicator("rolling_min_max", lambda: {"low": S.least("close", 20), "high": S.greatest("close", 20)}, {"low": f"min(close) {_B.format(19)}", "high": f"max(close) {_B.format(19)}"})
_mid, _dev = f"avg(close) {_B.format(19)}", f"stddev_pop(close) {_B.format(19)}"
_indicator("bollinger", lambda: S.bollinger("close"), {"middle": _full(20, _mid), "upper": _full(20, f"{_mid} + 2 * {_dev}"), "lower": _full(20, f"{_mid} - 2 * {_dev}"), "bandwidth": _full(20, f"4 * {_dev} / {_mid}")})
_indicator("vwap_cum", lambda: {"vwap": S.vwap()}, {"vwap": f"coalesce(sum((high + low + close) / 3 * volume) {_B.format('UNBOUNDED')} / nullif(sum(volume) {_B.format('UNBOUNDED')}, 0), 0)"})
_indicator("vwap_rolling", lambda: {"vwap": S.vwap(10)}, {"vwap": f"coalesce(sum((high + low + close) / 3 * volume) {_B.format(9)} / nullif(sum(volume) {_B.format(9)}, 0), 0)"})
_indicator("volatility", lambda: {"volatility": S.volatility("close", 20)}, {"volatility": f"{_dev} / {_mid}"})


_indicator("percent_b", lambda: {"b": S.percent_b("close")}, {"b": _full(20, f"(close - ({_mid} - 2 * {_dev})) / nullif(4 * {_dev}, 0)")})
_indicator("mean_move", lambda: {"move": S.mean_move("close", 3)}, {"move": "(" + " + ".join(f"abs(lag(close, {k}) OVER (PARTITION BY symbol ORDER BY timestamp) - lag(close, {k + 1}) OVER (PARTITION BY symbol ORDER BY timestamp))" for k in range(3)) + ") / 3"})


@query(f"WITH {BARS}, x AS (SELECT *, CASE WHEN lag(close) OVER w IS NULL OR close > lag(close) OVER w THEN volume WHEN close < lag(close) OVER w THEN -volume ELSE 0 END AS v FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)) SELECT symbol, timestamp, round(sum(v) OVER (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING), 4) AS obv FROM x")
def obv(spark, d):
    return ind.with_obv(bars(spark, d), S).select("symbol", "timestamp", r("obv", 4).alias("obv"))


def _recursive(value: str, alpha: float, seed: int, first: int, name: str = "y") -> str:
    """CTEs for a smoothed column of n (symbol, timestamp, rn, ``value``), seeded at row ``first``."""
    begin = f"avg({value}) FILTER (rn > {first - seed} AND rn <= {first})"
    return f"""{name}(symbol, rn, {name}) AS (SELECT symbol, {first}, {begin} FROM n GROUP BY symbol HAVING count(*) >= {first}
    UNION ALL SELECT n.symbol, n.rn, {alpha!r} * n.{value} + {1 - alpha!r} * p.{name} FROM {name} p JOIN n ON n.symbol = p.symbol AND n.rn = p.rn + 1)"""


_NUM = f"n AS (SELECT *, {_N} AS rn, greatest(close - lag(close) OVER w, 0) AS gain, greatest(lag(close) OVER w - close, 0) AS loss, coalesce(greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)), high - low) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp))"
_RB = "WITH RECURSIVE " + BARS + ", " + _NUM + ", "


@query(_RB + _recursive("close", 2 / 13, 1, 1) + " SELECT n.symbol, timestamp, round(y, 6) AS ema FROM n JOIN y ON n.symbol = y.symbol AND n.rn = y.rn")
def ema_first(spark, d):
    return ind.ema(bars(spark, d), S, "close", 12).select("symbol", "timestamp", r("ema").alias("ema"))


@query(_RB + _recursive("close", 2 / 13, 12, 12) + " SELECT n.symbol, timestamp, round(y, 6) AS ema FROM n LEFT JOIN y ON n.symbol = y.symbol AND n.rn = y.rn")
def ema_sma_seed(spark, d):
    return ind.ema(bars(spark, d), S, "close", 12, seed="sma").select("symbol", "timestamp", r("ema").alias("ema"))


@query(
    _RB
    + _recursive("close", 2 / 13, 1, 1, "f")
    + ", "
    + _recursive("close", 2 / 27, 1, 1, "s")
    + """, m AS (SELECT f.symbol, f.rn, f - s AS m FROM f JOIN s ON f.symbol = s.symbol AND f.rn = s.rn),
    g(symbol, rn, g) AS (SELECT symbol, rn, m FROM m WHERE rn = 26 UNION ALL SELECT m.symbol, m.rn, 0.2 * m.m + 0.8 * g.g FROM g JOIN m ON m.symbol = g.symbol AND m.rn = g.rn + 1)
    SELECT n.symbol, timestamp, round(CASE WHEN n.rn >= 26 THEN m END, 6) AS macd, round(g, 6) AS signal, round(m - g, 6) AS histogram
    FROM n JOIN m ON m.symbol = n.symbol AND m.rn = n.rn LEFT JOIN g ON g.symbol = n.symbol AND g.rn = n.rn"""
)
def macd(spark, d):
    return ind.macd(bars(spark, d), S, "close").select("symbol", "timestamp", *[r(c).alias(c) for c in ("macd", "signal", "histogram")])


@query(
    _RB
    + _recursive("gain", 1 / 14, 14, 15, "a")
    + ", "
    + _recursive("loss", 1 / 14, 14, 15, "b")
    + " SELECT n.symbol, timestamp, round(CASE WHEN b = 0 THEN 100 ELSE 100 - 100 / (1 + a / b) END, 6) AS rsi FROM n LEFT JOIN a ON a.symbol = n.symbol AND a.rn = n.rn LEFT JOIN b ON b.symbol = n.symbol AND b.rn = n.rn"
)
def rsi(spark, d):
    return ind.rsi(bars(spark, d), S, "close").select("symbol", "timestamp", r("rsi").alias("rsi"))


@query(_RB + _recursive("tr", 1 / 14, 14, 14) + " SELECT n.symbol, timestamp, round(y, 6) AS atr FROM n LEFT JOIN y ON n.symbol = y.symbol AND n.rn = y.rn")
def atr(spark, d):
    return ind.atr(bars(spark, d), S).select("symbol", "timestamp", r("atr").alias("atr"))


_A = "OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)"


@query(
    f"""WITH {BARS}, m AS (SELECT *, {_N} AS rn, high - lag(high) OVER w AS up, lag(low) OVER w - low AS down, CASE WHEN lag(close) OVER w IS NOT NULL THEN greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr
    FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)),
    i AS (SELECT *, 100 * sum(CASE WHEN up > down AND up > 0 THEN up ELSE 0 END) {_A} / nullif(sum(tr) {_A}, 0) AS p, 100 * sum(CASE WHEN down > up AND down > 0 THEN down ELSE 0 END) {_A} / nullif(sum(tr) {_A}, 0) AS q FROM m),
    x AS (SELECT *, CASE WHEN rn > 14 THEN coalesce(100 * abs(p - q) / nullif(p + q, 0), 0) END AS dx FROM i),
    a AS (SELECT symbol, timestamp, CASE WHEN rn >= 28 THEN avg(dx) {_A} END AS adx FROM x)
    SELECT symbol, timestamp, round(adx, 5) AS adx, CASE WHEN adx >= 40 THEN 'STRONG_TREND' WHEN adx >= 25 THEN 'TRENDING' WHEN adx IS NOT NULL THEN 'RANGING' END AS regime FROM a"""
)
def adx(spark, d):
    return ind.adx(bars(spark, d), S).select("symbol", "timestamp", r("adx", 5).alias("adx"), "regime")


# --- mutations ---------------------------------------------------------------------------------------------------

# Changes: the pending orders, moved to keys of which about half exist.
_NEW = "new AS (SELECT o_orderkey * 2 AS k, o_totalprice + 1 AS p, 'N' AS s FROM orders WHERE o_orderstatus = 'P'), old AS (SELECT o_orderkey AS k, o_totalprice AS p, o_orderstatus AS s FROM orders)"


def _changes(spark, d):
    o = read_table(spark, d, "orders")
    new = o.where("o_orderstatus = 'P'").select((F.col("o_orderkey") * 2).alias("k"), (F.col("o_totalprice") + 1).alias("p"), F.lit("N").alias("s"))
    return o.select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("p"), F.col("o_orderstatus").alias("s")), new


@query(f"WITH {_NEW} SELECT k, p, s FROM new UNION ALL SELECT k, p, s FROM old WHERE k NOT IN (SELECT k FROM new)")
def upsert(spark, d):
    return mut.upsert(*_changes(spark, d), ["k"])


@query(f"WITH {_NEW} SELECT coalesce(old.k, new.k) AS k, coalesce(new.p, old.p) AS p, coalesce(old.s, new.s) AS s FROM old FULL JOIN new ON old.k = new.k")
def on_conflict_partial(spark, d):
    return mut.upsert(*_changes(spark, d), ["k"], update=["p"])


@query(f"WITH {_NEW} SELECT k, p, s FROM old WHERE k NOT IN (SELECT k FROM new)")
def delete_key(spark, d):
    old, new = _changes(spark, d)
    return mut.delete_keys(old, new, ["k"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT (o_totalprice < 250000)")
def delete_where(spark, d):
    return mut.delete_where(read_table(spark, d, "orders"), F.col("o_totalprice") < 250000).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders")
def update_where(spark, d):
    return mut.update_where(read_table(spark, d, "orders"), F.col("o_orderstatus") == "P", {"o_totalprice": F.lit(0.0)}).select("o_orderkey", "o_totalprice")


@query(f"WITH {_NEW} SELECT k, p, s FROM old UNION ALL SELECT k, p, s FROM new WHERE k NOT IN (SELECT k FROM old)")
def merge_dedup(spark, d):
    old, new = _changes(spark, d)
    return mut.merge_absent(new, old, ["k"])


@query(f"WITH {TICKS}, x AS (SELECT symbol, user_id, arg_max(CASE WHEN id % 11 = 0 THEN -1 ELSE volume END, id) AS volume, arg_max(price, id) AS price FROM ticks GROUP BY symbol, user_id) SELECT symbol, user_id, volume, price FROM x WHERE volume >= 0")
def tombstone_filter(spark, d):
    log = ticks(spark, d).withColumn("volume", F.when(F.col("id") % 11 == 0, -1.0).otherwise(F.col("volume")))
    return mut.resolve_tombstones(log, ["symbol", "user_id"], "id").select("symbol", "user_id", "volume", "price")


# --- vectors -----------------------------------------------------------------------------------------------------

_PROBE = "(SELECT list_transform(range(0, len(embedding)), lambda i: [" + ", ".join(map(str, PROBE)) + "][(i % 8) + 1]::DOUBLE) FROM embeddings LIMIT 1)"
_SIM = f"list_cosine_similarity(embedding::DOUBLE[], {_PROBE})"


def _probe(e: DataFrame) -> list[float]:
    return [PROBE[i % 8] for i in range(DIM)]


@query(f"SELECT vec_id, round({_SIM}, 9) AS similarity FROM embeddings")
def cosine_sim(spark, d):
    e = read_table(spark, d, "embeddings")
    return e.select("vec_id", r(X.cosine_to(F.col("embedding"), _probe(e)), 9).alias("similarity"))


@query(f"SELECT vec_id, round({_SIM}, 9) AS similarity FROM embeddings WHERE {_SIM} >= 0 ORDER BY {_SIM} DESC, vec_id LIMIT 10")
def knn_topk(spark, d):
    e = read_table(spark, d, "embeddings")
    return vec.knn(e, _probe(e), 10).select("vec_id", r("similarity", 9).alias("similarity"))


@query(f"SELECT vec_id FROM embeddings WHERE {_SIM} >= 0.1")
def knn_threshold(spark, d):
    e = read_table(spark, d, "embeddings")
    return e.where(X.cosine_to(F.col("embedding"), _probe(e)) >= 0.1).select("vec_id")


@query(f"SELECT vec_id, round({_SIM} * exp(-ln(2) * greatest(1000000 - vec_id * 3000, 0) / 600000.0), 9) AS score FROM embeddings")
def decay_score(spark, d):
    e = read_table(spark, d, "embeddings")
    s = vec.decay(X.cosine_to(F.col("embedding"), _probe(e)), F.lit(1000000) - F.col("vec_id") * 3000, 600000)
    return e.select("vec_id", r(s, 9).alias("score"))


@query("SELECT count(*) AS n, sum(len(embedding) * 4 + 256)::BIGINT AS bytes FROM embeddings WHERE vec_id < (SELECT (max(vec_id) + 1) * 2 // 5 FROM embeddings)")
def archive_stats(spark, d):
    e = read_table(spark, d, "embeddings")
    cutoff = e.agg(F.expr("(max(vec_id) + 1) * 2 div 5")).first()[0]  # the ids stand for times
    _, archived = fa.archive(e, cutoff, ts="vec_id")
    return archived.agg(F.count("*").alias("n"), F.sum(F.size("embedding") * 4 + 256).alias("bytes"))


@query()
def hash_embed(spark, d):
    return read_table(spark, d, "conversations").select("conv_id", "turn", vec.hash_embedding(F.col("text")).alias("embedding"))


@query()
def ann_lsh(spark, d):
    e = read_table(spark, d, "embeddings")
    return vec.lsh_search(e, e.where("vec_id % 50 = 0"), 10, dim=DIM)


@query()
def ann_ivf(spark, d):
    e = read_table(spark, d, "embeddings")
    index = ann.Index.build(e, work_path(spark, "ivf"))
    queries = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return index.search(queries, 10, probes=max(1, len(index.centers) * 3 // 5))


@query()
def facts_search(spark, d):
    facts = read_table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("fact_id"), "text", F.col("role").alias("scope"))
    return fa.search(fa.write_facts(facts), "the and of", 5, scope="user").select("fact_id", r("similarity").alias("similarity"))


@query("WITH p AS (SELECT b.vec_id FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.4) SELECT vec_id FROM embeddings WHERE vec_id NOT IN (SELECT vec_id FROM p)")
def facts_dedup(spark, d):
    return fa.deduplicate(read_table(spark, d, "embeddings"), 0.4, unique="vec_id").select("vec_id")


# --- data quality ------------------------------------------------------------------------------------------------


@query("SELECT event_type, user_id, sum(n - 1)::BIGINT AS duplicates FROM (SELECT event_type, user_id, epoch_ms(ts) // 3600000 AS h, count(*) AS n FROM events GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING sum(n - 1) > 0")
def dq_duplicates(spark, d):
    e = ticks(spark, d).select(F.col("symbol").alias("event_type"), "user_id", F.expr("timestamp div 3600000").alias("timestamp"))
    return dq.duplicate_times(e, ["event_type", "user_id"])


@query("SELECT event_id AS id FROM (SELECT event_id, user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE value <= p")
def dq_out_of_order(spark, d):
    t = ticks(spark, d).select("id", "user_id", F.col("price").alias("timestamp"))
    return dq.out_of_order(t, ["user_id"], "id").select("id")


@query(f"WITH {BARS}, g AS (SELECT symbol, timestamp AS gap_from, lead(timestamp) OVER (PARTITION BY symbol ORDER BY timestamp) AS gap_to FROM bars) SELECT symbol, gap_from, gap_to, (gap_to - gap_from) // 3600000 - 1 AS missing FROM g WHERE gap_to - gap_from <> 3600000")
def dq_gaps(spark, d):
    return dq.gaps(bars(spark, d), ["symbol"], 3600000)


@query(
    f"""WITH {BARS}, x AS (SELECT symbol, timestamp, open, CASE WHEN timestamp % 5 = 0 THEN low - 1 ELSE high END AS high, low, close, volume - 100 AS volume FROM bars)
    SELECT symbol, timestamp, 'high_below_prices' AS violation FROM x WHERE high < greatest(open, close, low) UNION ALL SELECT symbol, timestamp, 'low_above_prices' FROM x WHERE low > least(open, close, high)
    UNION ALL SELECT symbol, timestamp, 'high_below_low' FROM x WHERE high < low UNION ALL SELECT symbol, timestamp, 'negative_volume' FROM x WHERE volume < 0 UNION ALL SELECT symbol, timestamp, 'price_not_positive' FROM x WHERE least(open, high, low, close) <= 0"""
)
def dq_ohlc(spark, d):
    b = bars(spark, d).withColumns({"high": F.when(F.col("timestamp") % 5 == 0, F.col("low") - 1).otherwise(F.col("high")), "volume": F.col("volume") - 100})
    return dq.price_violations(b, ["symbol"])


# --- analytics ---------------------------------------------------------------------------------------------------

_TR = "tr AS (SELECT c_mktsegment AS account, o_orderkey AS id, epoch_ms(o_orderdate) AS timestamp, o_totalprice - 200000 AS pnl FROM orders JOIN customer ON o_custkey = c_custkey)"


def _trades(spark, d):
    o, c = read_table(spark, d, "orders"), read_table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select(F.col("c_mktsegment").alias("account"), F.col("o_orderkey").alias("id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("timestamp"), (F.col("o_totalprice") - 200000).alias("pnl"))


@query(f"WITH {_TR} SELECT account, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, count(*) FILTER (pnl < 0) AS losses, round(sum(pnl), 2) AS total_pnl, round(avg(pnl), 4) AS avg_pnl, round(count(*) FILTER (pnl > 0) * 100.0 / count(*), 6) AS win_rate FROM tr GROUP BY account")
def trade_stats(spark, d):
    t = an.trade_stats(_trades(spark, d), ["account"])
    return t.withColumns({"total_pnl": r("total_pnl", 2), "avg_pnl": r("avg_pnl", 4), "win_rate": r("win_rate")})


_EQ = f"WITH {_TR}, e AS (SELECT *, 1000000 + sum(pnl) OVER (PARTITION BY account ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS equity FROM tr), p AS (SELECT *, greatest(1000000, max(equity) OVER (PARTITION BY account ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING)) AS peak FROM e)"


@query(_EQ + " SELECT account, id, round(equity, 2) AS equity, round(peak - equity, 2) AS drawdown FROM p")
def equity_curve(spark, d):
    t = an.equity_curve(_trades(spark, d), ["account"], ["timestamp", "id"], initial=1000000.0)
    return t.select("account", "id", r("equity", 2).alias("equity"), r("drawdown", 2).alias("drawdown"))


@query(_EQ + " SELECT account, round(max(peak - equity), 2) AS max_drawdown FROM p GROUP BY account")
def max_drawdown(spark, d):
    return an.max_drawdown(_trades(spark, d), ["account"], ["timestamp", "id"], initial=1000000.0).withColumn("max_drawdown", r("max_drawdown", 2))


@query(f"WITH {_TR} SELECT account, round(avg(pnl) / stddev_pop(pnl), 6) AS sharpe FROM tr GROUP BY account")
def sharpe(spark, d):
    return _trades(spark, d).groupBy("account").agg(r(an.sharpe(F.col("pnl"))).alias("sharpe"))


@query(
    _EQ
    + """, q AS (SELECT *, coalesce(equity / nullif(lag(equity) OVER (PARTITION BY account ORDER BY timestamp, id), 0) - 1, 0) AS ret FROM p)
    SELECT account, round(sum(pnl) / 1000000, 6) AS total_return, round(sum(pnl) / 1000000 * 365 / greatest((max(timestamp) - min(timestamp)) / 86400000.0, 1), 6) AS annual_return, round(count(*) FILTER (pnl > 0) * 100.0 / count(*), 6) AS win_rate,
    round(avg(pnl) FILTER (pnl > 0), 4) AS avg_win, round(avg(pnl) FILTER (pnl < 0), 4) AS avg_loss, round(sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0), 6) AS profit_factor, round(max((peak - equity) / peak), 6) AS max_drawdown, round(avg(ret) / stddev_pop(ret), 6) AS sharpe FROM q GROUP BY account"""
)
def backtest_result(spark, d):
    t = an.backtest_result(_trades(spark, d), ["account"], ["timestamp", "id"], "timestamp", initial=1000000.0)
    return t.select("account", *[r(c, 4 if c.startswith("avg") else 6).alias(c) for c in t.columns[1:]])


@query("SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS filled, round(sum(o_totalprice), 2) AS volume, round(avg(o_totalprice), 4) AS avg_amount, max(o_totalprice) AS max_amount FROM orders GROUP BY 1, 2")
def daily_report(spark, d):
    t = an.daily_report(read_table(spark, d, "orders"), ["o_orderpriority"], F.date_format("o_orderdate", "yyyy-MM-dd"), status="o_orderstatus", amount="o_totalprice", filled="F")
    return t.withColumns({"volume": r("volume", 2), "avg_amount": r("avg_amount", 4)})


@query("WITH t AS (SELECT o_custkey, sum(o_totalprice) AS exposure FROM orders GROUP BY 1) SELECT o_custkey, round(exposure, 2) AS exposure, CASE WHEN exposure > 3000000 THEN 'VIOLATION' WHEN exposure >= 2700000 THEN 'WARNING' ELSE 'OK' END AS status FROM t")
def risk_limits(spark, d):
    t = read_table(spark, d, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("exposure"))
    return an.risk_limits(t, "exposure", 3000000.0).select("o_custkey", r("exposure", 2).alias("exposure"), "status")


@query(
    """WITH RECURSIVE f AS (SELECT o_custkey AS account, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS side, o_totalprice / 1000 AS price, 1.0::DOUBLE AS qty,
    CASE WHEN o_orderstatus = 'F' THEN -1.0 ELSE 1.0 END::DOUBLE AS q, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders),
    p(account, id, side, price, qty, rn, position, avg_price, realised) AS (SELECT account, id, side, price, qty, rn, q, price, 0.0::DOUBLE FROM f WHERE rn = 1
    UNION ALL SELECT f.account, f.id, f.side, f.price, f.qty, f.rn, p.position + f.q,
      CASE WHEN p.position * f.q >= 0 THEN (p.avg_price * abs(p.position) + f.price * abs(f.q)) / (abs(p.position) + abs(f.q)) WHEN abs(f.q) > abs(p.position) THEN f.price WHEN abs(f.q) = abs(p.position) THEN 0.0 ELSE p.avg_price END,
      CASE WHEN p.position * f.q >= 0 THEN 0.0 ELSE least(abs(p.position), abs(f.q)) * (f.price - p.avg_price) * sign(p.position) END
    FROM p JOIN f ON f.account = p.account AND f.rn = p.rn + 1)
    SELECT account, id, side, round(price, 9) AS price, qty, position, round(avg_price, 9) AS avg_price, round(realised, 9) AS realised FROM p"""
)
def position_pnl(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_custkey").alias("account"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy").alias("side"), (F.col("o_totalprice") / 1000).alias("price"), F.lit(1.0).alias("qty"))
    return an.positions(o, ["account"], "id").withColumns({c: r(c, 9) for c in ("price", "avg_price", "realised")})


@query(f"WITH {_TR}, c AS (SELECT *, pnl + 200000 AS price, sum(pnl) OVER (PARTITION BY account ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING) AS s FROM tr), k AS (SELECT *, greatest(0, max(s) OVER (PARTITION BY account ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING)) AS peak FROM c) SELECT account, count(*) AS trades, count(*) FILTER (pnl > 0) AS wins, round(max(pnl), 4) AS max_win, round(min(pnl), 4) AS max_loss, round(count(*) FILTER (pnl > 0) / count(*), 6) AS win_rate, round(avg(pnl / price) / stddev_pop(pnl / price), 6) AS sharpe, round(coalesce(max(CASE WHEN peak > 0 THEN (peak - s) / peak END), 0), 6) AS max_drawdown FROM k GROUP BY account")
def performance(spark, d):
    t = an.performance(_trades(spark, d).withColumn("price", F.col("pnl") + 200000), ["account"], ["timestamp", "id"])
    return t.select("account", "trades", "wins", r("max_win", 4).alias("max_win"), r("max_loss", 4).alias("max_loss"), *[r(c).alias(c) for c in ("win_rate", "sharpe", "max_drawdown")])


@query(f"WITH {_TR} SELECT account, id, timestamp, pnl FROM tr WHERE account = 'BUILDING' AND timestamp >= 946684800000 ORDER BY timestamp DESC, id DESC LIMIT 40")
def trades_newest(spark, d):
    t = _trades(spark, d).withColumnRenamed("account", "symbol")
    return an.newest_trades(t, symbol="BUILDING", start=946684800000, limit=40).select(F.col("symbol").alias("account"), "id", "timestamp", "pnl")


@query(f"WITH {_TR} SELECT account, id, timestamp FROM tr QUALIFY row_number() OVER (PARTITION BY account ORDER BY timestamp DESC, id DESC) <= 15")
def metrics_last_n(spark, d):
    return an.last_metrics(_trades(spark, d), 15, keys=["account"]).select("account", "id", "timestamp")


@query(f"WITH {_TR}, s AS (SELECT account, round(avg(pnl) / stddev_pop(pnl), 9) AS sharpe FROM tr GROUP BY account) SELECT account, round(sharpe, 6) AS sharpe, row_number() OVER (ORDER BY sharpe DESC NULLS LAST, account) AS rank FROM s")
def param_ranking(spark, d):
    runs = _trades(spark, d).groupBy("account").agg(r(an.sharpe(F.col("pnl")), 9).alias("sharpe"))
    return an.rank_runs(runs, unique=["account"]).select("account", r("sharpe").alias("sharpe"), F.col("rank").cast("long").alias("rank"))


@query(
    """SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, o_orderpriority, count(*) AS trades, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus <> 'F'), 0), 2) AS buy_volume, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS sell_volume,
    round(sum(o_totalprice - 200000), 2) AS pnl, round(sum(o_totalprice * 0.001), 6) AS fees, round(sum(o_totalprice - 200000) - sum(o_totalprice * 0.001), 2) AS net_pnl, round(count(*) FILTER (o_totalprice > 200000) / count(*), 6) AS win_rate FROM orders GROUP BY 1, 2"""
)
def daily_trades(spark, d):
    o = read_table(spark, d, "orders").withColumns({"pnl": F.col("o_totalprice") - 200000, "fee": F.col("o_totalprice") * 0.001, "side": F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy")})
    t = an.trades_report(o, ["o_orderpriority"], F.date_format("o_orderdate", "yyyy-MM-dd"), pnl="pnl", fee="fee", side="side", amount="o_totalprice")
    return t.withColumns({c: r(c, n) for c, n in (("buy_volume", 2), ("sell_volume", 2), ("pnl", 2), ("fees", 6), ("net_pnl", 2), ("win_rate", 6))})


@query(
    f"""WITH {TICKS}, h AS (SELECT user_id, symbol, count(*)::DOUBLE AS position, avg(price) AS average FROM ticks WHERE symbol <> 'error' GROUP BY 1, 2), m AS (SELECT symbol, arg_max(price, timestamp) AS price FROM ticks WHERE symbol <> 'view' GROUP BY 1)
    SELECT user_id, round(1000 + sum(position * coalesce(price, average)), 4) AS equity, round(sum(position * (coalesce(price, average) - average)), 4) AS unrealised FROM h LEFT JOIN m USING (symbol) GROUP BY user_id"""
)
def equity_marked(spark, d):
    t = ticks(spark, d)
    held = t.where("symbol <> 'error'").groupBy("user_id", "symbol").agg(F.count("*").cast("double").alias("position"), F.avg("price").alias("average")).withColumn("cash", F.lit(1000.0))
    marks = t.where("symbol <> 'view'").groupBy("symbol").agg(F.max_by("price", "timestamp").alias("price"))
    return an.marked_equity(held, marks, ["user_id"], cash="cash", position="position", average="average").select("user_id", r("equity", 4).alias("equity"), r("unrealised", 4).alias("unrealised"))


@query("SELECT a AS fast, b AS slow, c AS signal FROM (VALUES (5), (10), (12)) x(a), (VALUES (20), (26)) y(b), (VALUES (7), (9)) z(c)")
def param_grid(spark, d):
    return an.param_grid(spark, fast=[5, 10, 12], slow=[20, 26], signal=[7, 9])


# --- streaming ---------------------------------------------------------------------------------------------------


def _stream(spark, d, run):
    """Runs a stream over the events table in a new folder; the state store setting is put back."""
    from chronolith.streaming import file_stream

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        schema = read_table(spark, d, "events").schema
        e = file_stream(spark, d, schema, pattern="events.parquet")
        k = F.get_json_object("props", "$.k").cast("double")
        t = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), k.alias("volume"))
        return run(t, work_path(spark, "stream"))
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def _streamed(spark, d, make) -> DataFrame:
    from chronolith.streaming import run_to_table, stream_indicators

    return _stream(spark, d, lambda t, path: run_to_table(stream_indicators(t.drop("volume"), make), path, "append"))


@query(f"WITH {BARS} SELECT symbol, timestamp, open, high, low, close, volume FROM bars")
def stream_sample_by(spark, d):
    from chronolith.streaming import run_to_table, stream_bars

    out = _stream(spark, d, lambda t, path: run_to_table(stream_bars(t, "1 hour", "2 hours"), path, "complete"))
    return out.select("symbol", F.unix_millis("bar_start").alias("timestamp"), "open", "high", "low", "close", "volume")


_NT = f"n AS (SELECT *, row_number() OVER w AS rn, greatest(price - lag(price) OVER w, 0) AS gain, greatest(lag(price) OVER w - price, 0) AS loss FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY timestamp, id))"
_RT = "WITH RECURSIVE " + TICKS + ", " + _NT + ", "
_TB = "OVER (PARTITION BY symbol ORDER BY timestamp, id ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"


@query(_RT + _recursive("price", 2 / 13, 1, 1) + " SELECT n.symbol, id, price, y AS ema FROM n JOIN y ON n.symbol = y.symbol AND n.rn = y.rn")
def stream_ema(spark, d):
    from chronolith.streaming import Ema

    return _streamed(spark, d, lambda: [Ema(12)])  # the same operations in the same order: equal to the last bit


@query(f"WITH {TICKS} SELECT symbol, id, price, round(avg(price) {_TB.format(11)}, 6) AS sma FROM ticks")
def stream_sma(spark, d):
    from chronolith.streaming import Sma

    return _streamed(spark, d, lambda: [Sma(12)]).withColumn("sma", r("sma"))


@query(_RT + _recursive("gain", 1 / 14, 14, 15, "a") + ", " + _recursive("loss", 1 / 14, 14, 15, "b") + " SELECT n.symbol, id, price, round(CASE WHEN b = 0 THEN 100 WHEN b IS NULL THEN 0 ELSE 100 - 100 / (1 + a / b) END, 6) AS rsi FROM n LEFT JOIN a ON a.symbol = n.symbol AND a.rn = n.rn LEFT JOIN b ON b.symbol = n.symbol AND b.rn = n.rn")
def stream_rsi(spark, d):
    from chronolith.streaming import Rsi

    return _streamed(spark, d, lambda: [Rsi(14)]).withColumn("rsi", r("rsi"))


def _macd_sma(n: str) -> str:
    """MACD of averages seeded with means, from ``n``'s column of that name: CTEs up to l (symbol, rn, m, g)."""
    return (
        _recursive(n, 2 / 13, 12, 12, "f") + ", " + _recursive(n, 2 / 27, 26, 26, "s")
        + """, m AS (SELECT f.symbol, f.rn, f - s AS m FROM f JOIN s ON f.symbol = s.symbol AND f.rn = s.rn),
        g(symbol, rn, g) AS (SELECT symbol, 34, avg(m) FILTER (rn <= 34) FROM m GROUP BY symbol HAVING count(*) >= 9 UNION ALL SELECT m.symbol, m.rn, 0.2 * m.m + 0.8 * g.g FROM g JOIN m ON m.symbol = g.symbol AND m.rn = g.rn + 1),
        l AS (SELECT m.symbol, m.rn, m, g FROM m LEFT JOIN g ON g.symbol = m.symbol AND g.rn = m.rn)"""
    )


@query(_RT + _macd_sma("price") + " SELECT n.symbol, id, price, round(coalesce(m, 0), 6) AS macd, round(coalesce(g, 0), 6) AS signal, round(coalesce(m - g, 0), 6) AS histogram FROM n LEFT JOIN l ON l.symbol = n.symbol AND l.rn = n.rn")
def stream_macd(spark, d):
    from chronolith.streaming import Macd

    return _streamed(spark, d, lambda: [Macd()]).withColumns({c: r(c) for c in Macd.names})


@query(f"WITH {TICKS} SELECT symbol, id, price, round(avg(price) {_TB.format(19)}, 6) AS middle, round(avg(price) {_TB.format(19)} + 2 * stddev_pop(price) {_TB.format(19)}, 6) AS upper, round(avg(price) {_TB.format(19)} - 2 * stddev_pop(price) {_TB.format(19)}, 6) AS lower FROM ticks")
def stream_bollinger(spark, d):
    from chronolith.streaming import Bollinger

    return _streamed(spark, d, lambda: [Bollinger()]).withColumns({c: r(c) for c in Bollinger.names})


# --- forms of operators that differ in a parameter ---------------------------------------------------------------


_indicator("rolling_std_zero", lambda: {"std": S.std("close", 20, "zero")}, {"std": f"CASE WHEN {_N} >= 20 THEN {_dev} ELSE 0 END"})
_indicator("rolling_std_expanding", lambda: {"std": S.std("close", 20, "expanding")}, {"std": _dev})
_indicator("grid_spacing", lambda: {"spacing": S.grid_spacing("close", 20, 0.01, 0.005, 0.3)}, {"spacing": f"greatest(0.005, least(0.3, 0.01 * (1 + coalesce({_dev} / {_mid}, 0) * 100)))"})
_indicator("indicator_manager", lambda: {"sma5": S.sma("close", 5), "max20": S.greatest("close", 20)}, {"sma5": _full(5, f"avg(close) {_B.format(4)}"), "max20": f"max(close) {_B.format(19)}"})


@query(f"WITH {BARS} SELECT symbol, timestamp, round(avg(close) {_B.format(19)}, 6) AS sma FROM bars QUALIFY {_N} >= 20")
def sma_valid(spark, d):
    return ind.valid_sma(bars(spark, d), S, "close", 20).select("symbol", "timestamp", r("sma").alias("sma"))


@query(_RB + _macd_sma("close") + " SELECT n.symbol, timestamp, round(m, 6) AS macd, round(g, 6) AS signal, round(m - g, 6) AS histogram FROM n LEFT JOIN l ON l.symbol = n.symbol AND l.rn = n.rn")
def macd_sma_seed(spark, d):
    return ind.macd(bars(spark, d), S, "close", seed="sma").select("symbol", "timestamp", *[r(c).alias(c) for c in ("macd", "signal", "histogram")])


# Prices that only rise, so that the average loss is 0.
@query(f"WITH {BARS} SELECT symbol, timestamp, CASE WHEN {_N} >= 15 THEN 99.0099 END::DOUBLE AS rsi FROM bars")
def rsi_no_loss(spark, d):
    rising = bars(spark, d).withColumn("close", F.col("timestamp") / 1000.0)
    return ind.rsi(rising, S, "close", no_loss=100 - 100 / 101).select("symbol", "timestamp", r("rsi", 4).alias("rsi"))


@query("WITH RECURSIVE " + BARS + f", n AS (SELECT *, {_N} AS rn, greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)), " + _recursive("tr", 1 / 14, 14, 15) + " SELECT n.symbol, timestamp, round(y, 6) AS atr FROM n LEFT JOIN y ON n.symbol = y.symbol AND n.rn = y.rn")
def atr_null_start(spark, d):
    return ind.atr(bars(spark, d), S, first="none").select("symbol", "timestamp", r("atr").alias("atr"))


# Hours of the night without volume: the last value is kept there.
_QUIET = BARS + ", q AS (SELECT * REPLACE (CASE WHEN timestamp // 3600000 % 24 < 8 THEN 0 ELSE volume END AS volume) FROM bars)"


def _quiet(spark, d) -> DataFrame:
    return bars(spark, d).withColumn("volume", F.when(F.expr("timestamp div 3600000") % 24 < 8, 0.0).otherwise(F.col("volume")))


def _vwap_close(frame: str) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY timestamp ROWS BETWEEN {frame} PRECEDING AND CURRENT ROW)"
    return f"WITH {_QUIET}, v AS (SELECT symbol, timestamp, sum(close * volume) {w} / nullif(sum(volume) {w}, 0) AS v FROM q) SELECT symbol, timestamp, round(last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY timestamp ROWS UNBOUNDED PRECEDING), 6) AS vwap FROM v"


@query(_vwap_close("UNBOUNDED"))
def vwap_close(spark, d):
    return ind.with_vwap_close(_quiet(spark, d), S).select("symbol", "timestamp", r("vwap").alias("vwap"))


@query(_vwap_close("4"))
def vwap_close_rolling(spark, d):
    return ind.with_vwap_close(_quiet(spark, d), S, 5).select("symbol", "timestamp", r("vwap").alias("vwap"))


@query(f"WITH {TICKS} SELECT id, timestamp AS decoded FROM ticks")
def delta_decode(spark, d):
    keys = {"keys": ["symbol"], "order": ["timestamp", "id"]}
    return ts.delta_decode(ts.delta_encode(ticks(spark, d), "timestamp", **keys), "delta", span=DAY, **keys).select("id", "decoded")


@query("SELECT o_orderpriority, count(*) AS n, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY o_orderpriority")
def agg_first_row(spark, d):
    return ts.first_rows(read_table(spark, d, "orders"), ["o_orderpriority"], ["o_orderkey"], ["o_orderstatus"], n=F.count("*"))


@query(f"WITH {BARS}, f AS (SELECT symbol, timestamp AS gap_from, lead(timestamp) OVER w AS gap_to, row_number() OVER w AS rn FROM bars WHERE timestamp // 3600000 % 7 <> 3 WINDOW w AS (PARTITION BY symbol ORDER BY timestamp)), g AS (SELECT *, max(gap_to - gap_from) FILTER (rn = 1) OVER (PARTITION BY symbol) AS step FROM f) SELECT symbol, gap_from, gap_to, step FROM g WHERE gap_to - gap_from <> step")
def dq_gaps_first_step(spark, d):
    return dq.gaps(bars(spark, d).where(F.expr("timestamp div 3600000") % 7 != 3), ["symbol"])


@query(f"WITH {BARS}, x AS (SELECT symbol, timestamp, open, CASE WHEN timestamp % 5 = 0 THEN low - 1 ELSE high END AS high, low, CASE WHEN timestamp % 3 = 0 THEN 'inf'::DOUBLE ELSE close END AS close, volume FROM bars) SELECT symbol, timestamp FROM x WHERE isfinite(close) AND high >= greatest(open, close, low) AND low <= least(open, close, high) AND volume >= 0")
def dq_valid_bars(spark, d):
    b = bars(spark, d).withColumns({"high": F.when(F.col("timestamp") % 5 == 0, F.col("low") - 1).otherwise(F.col("high")), "close": F.when(F.col("timestamp") % 3 == 0, float("inf")).otherwise(F.col("close"))})
    return dq.valid_bars(b).select("symbol", "timestamp")


def _dialect(spark, d, text: str, **tables: DataFrame) -> DataFrame:
    dialect = Dialect(spark)
    for name, df in tables.items():
        dialect.register(name, df)
    return dialect.sql(text)


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2 ORDER BY 2, 3 DESC, 1 LIMIT 8")
def order_ordinal(spark, d):
    return _dialect(spark, d, "SELECT o_orderpriority, o_orderstatus, COUNT(*) AS n FROM orders GROUP BY o_orderpriority, o_orderstatus ORDER BY 2, 3 DESC, 1 LIMIT 8", orders=read_table(spark, d, "orders"))


@query("SELECT c_custkey, coalesce(o_orderkey::VARCHAR, '') || '/' || c_mktsegment AS label FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) o ON c_custkey = o_custkey")
def dialect_concat(spark, d):
    big = read_table(spark, d, "orders").where("o_totalprice > 400000")
    return _dialect(spark, d, "SELECT c_custkey, o_orderkey || '/' || c_mktsegment AS label FROM customer LEFT JOIN big ON c_custkey = o_custkey", customer=read_table(spark, d, "customer"), big=big)


@query(f"SELECT vec_id, round({_SIM}, 6) AS similarity FROM embeddings WHERE {_SIM} > 0.1")
def dialect_vectors(spark, d):
    e = read_table(spark, d, "embeddings")
    sim = f"COSINE_SIM(embedding, [{', '.join(map(str, _probe(e)))}])"
    return _dialect(spark, d, f"SELECT vec_id, {sim} AS similarity FROM vectors WHERE {sim} > 0.1", vectors=e).withColumn("similarity", r("similarity"))


@query(f"WITH {BARS} SELECT symbol, strftime(epoch_ms(timestamp), '%Y-%m-%d') AS day, round(lag(close) OVER (PARTITION BY symbol ORDER BY timestamp), 6) AS before FROM bars")
def dialect_strftime_over(spark, d):
    t = _dialect(spark, d, "SELECT symbol, STRFTIME(timestamp, '%Y-%m-%d') OVER (PARTITION BY symbol) AS day, LAG(close) OVER (PARTITION BY symbol ORDER BY timestamp) AS before FROM bars", bars=bars(spark, d))
    return t.withColumn("before", r("before"))


@query(f"SELECT vec_id, round({_SIM} * exp(-ln(2) * greatest(1000000000 - vec_id * 3000000, 0) / 604800000.0), 9) AS score FROM embeddings WHERE label <> 3 ORDER BY {_SIM} * exp(-ln(2) * greatest(1000000000 - vec_id * 3000000, 0) / 604800000.0) DESC, vec_id LIMIT 12")
def facts_decay(spark, d):
    e = read_table(spark, d, "embeddings")
    facts = e.where("label <> 3").withColumn("timestamp", F.col("vec_id") * 3000000)
    return fa.search_with_decay(facts, _probe(e), 12, now=1000000000, half_life="7d", unique="vec_id").select("vec_id", r("score", 9).alias("score"))


@query("SELECT vec_id FROM embeddings WHERE label = 2 ORDER BY vec_id DESC LIMIT 9")
def facts_list(spark, d):
    facts = read_table(spark, d, "embeddings").withColumnsRenamed({"label": "type"}).withColumn("timestamp", F.col("vec_id"))
    return fa.list_facts(facts, kind=2, limit=9, unique="vec_id").select("vec_id")


@query("SELECT DISTINCT CASE o_custkey % 4 WHEN 0 THEN '1h' WHEN 1 THEN '4h' WHEN 2 THEN '1d' ELSE '15m' END AS interval, CASE o_custkey % 4 WHEN 0 THEN 24 WHEN 1 THEN 6 WHEN 2 THEN 1 ELSE 96 END::BIGINT AS bars FROM orders")
def interval_names(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ("60", "240", "1440", "15"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    names = read_table(spark, d, "orders").select(schemas.canonical_interval(raw).alias("interval")).distinct()
    counts = F.lit(None).cast("long")
    for name in ("1h", "4h", "1d", "15m"):
        counts = F.when(F.col("interval") == name, schemas.bars_count(F.lit(DAY), name)).otherwise(counts)
    return names.withColumn("bars", counts)
