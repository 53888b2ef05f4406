"""Vector similarity: exact search, thresholds, decay, duplicate pairs, hashing embeddings, LSH search."""

from __future__ import annotations

import itertools
import json
import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolith.functions import cosine_to

PIVOTS = 32
STRIP = 128  # rows of a block that are multiplied at a time
EMBED_STRIP = 64  # texts that are held as strings
LEAST_BLOCK, BLOCK_VALUES, SPREAD = 4096, 1 << 21, 14  # rows of a block at least, numbers in it at most, blocks that all rows make at least, if they can
SEARCH_ASKED, SEARCH_ROWS, SEARCH_STRIP = 4096, 8192, 128  # queries and rows of a search's blocks, queries that are multiplied at a time


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def knn(vectors: DataFrame, query: list[float], k: int, *, threshold: float = 0.0, vector: str = "embedding", unique: str = "vec_id") -> DataFrame:
    """The k most similar rows; vectors of another length do not match. A partial top-k on each partition."""
    scored = vectors.where(F.size(vector) == len(query)).withColumn("similarity", cosine_to(F.col(vector), query))
    return scored.where(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), unique).limit(k)


def decay(similarity: Column, age_ms: Column, half_life_ms: int) -> Column:
    """Similarity halved with every half-life; times in the future have age 0."""
    return similarity * F.exp(-F.lit(math.log(2)) * F.greatest(age_ms, F.lit(0)) / F.lit(half_life_ms))


def planes(dim: int, tables: int, bits: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tables, bits, dim))


def _groups(vectors: DataFrame, vector: str, unique: str) -> tuple[DataFrame, DataFrame]:
    """Rows (key, id) of all vectors, and one row (key, v, d, first, n) for each group of equal ones.

    The key depends on the values alone; ``first`` is the group's least id. Rows without an id or a vector pair with nothing."""
    rows = vectors.where(F.col(unique).isNotNull() & F.col(vector).isNotNull()).select(F.col(unique).alias("id"), F.col(vector).alias("v"))
    rows = rows.withColumn("key", F.unhex(F.sha2(F.col("v").cast("string"), 256)))
    groups = rows.groupBy("key").agg(F.any_value("v").alias("v"), F.min("id").alias("first"), F.count("*").alias("n"))
    return rows.select("key", "id"), groups.withColumn("d", F.size("v"))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m.astype(float)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def _block_rows(n: int, dim: int) -> int:
    """Rows of a block: each block is sent to every block near it, so fewer and larger ones send less."""
    return max(LEAST_BLOCK, min(n // SPREAD, BLOCK_VALUES // max(dim, 1)))


def _cells(groups: DataFrame, threshold: float, block: int | None) -> tuple[DataFrame, list[tuple[int, int]], list[list[int]]]:
    """Groups with the cell of their nearest pivot, each cell's (first block, blocks), and the cells near each.

    A cell's vectors lie within an angle of its pivot; two cells are not compared if their pivots are further apart than
    both angles and the threshold's. Vectors of another length than the pivots' have a cell of their own, near to all."""
    n, widest = groups.agg(F.count("*"), F.max("d")).first()
    pivots = [r.v for r in groups.orderBy("key").limit(max(1, min(PIVOTS, n // (block or LEAST_BLOCK)))).collect()]  # at most PIVOTS rows
    dim = len(pivots[0]) if pivots else 0
    block = block or _block_rows(n, widest or 0)
    p = _unit(np.array([v for v in pivots if len(v) == dim], float).reshape(-1, dim))
    other = len(p)

    def place(vs: pd.Series) -> pd.DataFrame:
        c, angle = np.full(len(vs), other), np.full(len(vs), math.pi)
        for at, v in enumerate(vs):
            u = _unit(np.array([v], float))
            if len(v) == dim and np.isfinite(u).all() and u.any():
                cosines = (p @ u[0]).clip(-1, 1)
                c[at] = cosines.argmax()
                angle[at] = math.acos(cosines[c[at]])
        return pd.DataFrame({"c": c, "angle": angle})

    placed = groups.withColumn("p", F.pandas_udf(place, "struct<c int, angle double>")("v"))
    sizes = {r.c: r for r in placed.groupBy("p.c").agg(F.count("*").alias("n"), F.max("p.angle").alias("angle")).collect()}  # at most PIVOTS + 1 rows
    blocks, at = [], 0
    for c in range(other + 1):
        k = math.ceil(sizes[c].n / block) if c in sizes else 0
        blocks.append((at, k))
        at += k
    far = math.acos(min(1.0, threshold)) + 1e-6 if threshold > 0 else math.inf

    def near(a: int, b: int) -> bool:
        if other in (a, b) or a == b:
            return True
        return math.acos(float(np.clip(p[a] @ p[b], -1, 1))) - sizes[a].angle - sizes[b].angle <= far

    return placed, blocks, [[b for b in range(other + 1) if b in sizes and a in sizes and near(a, b)] for a in range(other + 1)]


def _compare(groups: DataFrame, threshold: float, block: int | None) -> Callable[..., DataFrame]:
    """A function of (found, schema, shared) that gives ``found(rows of a, rows of b, similarities)`` over every two blocks of
    near cells, in strips of rows; rows are (keys, firsts), the similarity is -inf where a pair is met twice. Without
    ``shared`` all groups meet, else those pairs of which one group has several members (True) or none has (False); only
    groups of several members have a key then. A block is one row: a matrix of at most about ``block`` vectors."""
    placed, cells, near = _cells(groups, threshold, block)
    pick = lambda values, kind: F.from_json(F.lit(json.dumps(values)), kind)
    first, count = pick([c[0] for c in cells], "array<int>"), pick([c[1] for c in cells], "array<int>")
    own = F.get(first, F.col("p.c")) + F.pmod(F.xxhash64("key"), F.get(count, F.col("p.c"))).cast("int")
    ranges = pick([[list(cells[b]) for b in bs] for bs in near], "array<array<array<int>>>")
    whom = F.flatten(F.transform(F.get(ranges, F.col("c")), lambda r: F.sequence(r[0], r[0] + r[1] - 1)))
    kind = groups.schema["first"].dataType.simpleString()
    value = "f4" if groups.schema["v"].dataType.simpleString() == "array<float>" else "f8"

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = np.array(rows.v.tolist(), value)
        return pd.DataFrame({"own": [key[0]], "c": [key[1]], "d": [key[2]], "keys": [[k if n > 1 else None for k, n in zip(rows.key, rows.n)]], "firsts": [rows["first"].tolist()], "m": [m.tobytes()]})

    packed = placed.select(own.alias("own"), F.col("p.c").alias("c"), "d", "key", "first", "n", "v").groupBy("own", "c", "d")
    packed = packed.applyInPandas(pack, f"own int, c int, d int, keys array<binary>, firsts array<{kind}>, m binary")
    sides = packed.withColumn("with", F.explode(whom)).select(F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"), "d", "own", "keys", "firsts", "m")

    def over(found, schema: str, shared: bool | None = None) -> DataFrame:
        def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            both = sorted((r for batch in batches for r in batch.itertuples()), key=lambda r: r.own)  # one row or two
            if len(both) < 2 and both[0].x != both[0].y:
                return
            load = lambda r: (_unit(np.frombuffer(r.m, value).reshape(len(r.keys), -1)), np.array(r.keys, object), np.array(r.firsts))
            same = both[0].own == both[-1].own
            a = load(both[0])
            b = a if same else load(both[-1])
            whole_a, whole_b = np.arange(len(a[0])), np.arange(len(b[0]))
            if shared is None:
                parts = [(whole_a, whole_b)]
            else:
                many_a, many_b = (np.array([k is not None for k in s[1]], bool) for s in (a, b))
                single = whole_a[~many_a]
                parts = [(whole_a[many_a], whole_b), (single, whole_b[many_b])] if shared else [(single, whole_b[~many_b])]
            for left, right in parts:
                mb, rb = b[0][right], (b[1][right], b[2][right])
                for at in range(0, len(left) if len(right) else 0, STRIP):
                    rows = left[at : at + STRIP]
                    sims = a[0][rows] @ mb.T
                    if same:
                        sims[rows[:, None] >= right] = -np.inf
                    yield found((a[1][rows], a[2][rows]), rb, sims)

        return sides.groupBy("x", "y", "d").applyInPandas(compare, schema)

    return over


def _alike(groups: DataFrame, threshold: float) -> DataFrame:
    """Groups whose own members' similarity, 1 (0 without a direction), reaches the threshold."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    return groups.where((F.col("n") > 1) & ~F.isnan(norm) & norm.isNotNull() & (F.when(norm > 0, 1.0).otherwise(0.0) >= threshold)).withColumn("similarity", F.when(norm > 0, 1.0).otherwise(0.0))


def similar_pairs(vectors: DataFrame, threshold: float, *, vector: str = "embedding", unique: str = "vec_id", block: int | None = None) -> DataFrame:
    """All pairs with similarity of at least the threshold, exact for tables of any size.

    Equal vectors are compared once, as one group; groups are compared by matrix products of blocks, without those that
    pivots keep apart. Work grows with the square of the groups that pivots leave together, and the result has a row for
    every pair, also of equal vectors: :func:`similar_to_earlier` needs none of these rows. Pairs of vectors that have no
    equal come from the blocks with their ids; only pairs of a group with equal vectors are joined with its members.
    Vectors of different lengths do not match."""
    members, groups = _groups(vectors, vector, unique)
    kind = groups.schema["first"].dataType.simpleString()
    over = _compare(groups, threshold, block)

    def found(a, b, sims) -> pd.DataFrame:
        i, j = np.nonzero(sims >= threshold)
        return pd.DataFrame({"ka": a[0][i], "fa": a[1][i], "kb": b[0][j], "fb": b[1][j], "similarity": sims[i, j]})

    def alone(a, b, sims) -> pd.DataFrame:
        i, j = np.nonzero(sims >= threshold)
        return pd.DataFrame({"id_a": a[1][i], "id_b": b[1][j], "similarity": sims[i, j]})

    pairs = over(alone, f"id_a {kind}, id_b {kind}, similarity double", False)
    several = groups.where("n > 1")
    if not several.isEmpty():
        links = over(found, f"ka binary, fa {kind}, kb binary, fb {kind}, similarity double", True)
        links = links.select(*[F.coalesce(f"k{s}", F.unhex(F.md5(F.col(f"f{s}").cast("string")))).alias(f"k{s}") for s in "ab"], *[F.when(F.col(f"k{s}").isNull(), F.col(f"f{s}")).alias(f"f{s}") for s in "ab"], "similarity")
        own = _alike(groups, threshold).select(F.col("key").alias("ka"), F.lit(None).cast(kind).alias("fa"), F.col("key").alias("kb"), F.lit(None).cast(kind).alias("fb"), "similarity")
        of = members.join(several.select("key"), "key", "left_semi")
        a, b = (of.select(F.col("key").alias(f"k{s}"), F.col("id").alias(f"m{s}")) for s in "ab")
        met = links.unionByName(own).join(a, "ka", "left").join(b, "kb", "left")
        met = met.select("ka", "kb", F.coalesce("fa", "ma").alias("id_a"), F.coalesce("fb", "mb").alias("id_b"), "similarity")
        pairs = pairs.unionByName(met.where((F.col("ka") != F.col("kb")) | (F.col("id_a") < F.col("id_b"))).drop("ka", "kb"))
    return pairs.where("id_a <> id_b").select(F.least("id_a", "id_b").cast(kind).alias("id_a"), F.greatest("id_a", "id_b").cast(kind).alias("id_b"), "similarity")


def similar_to_earlier(vectors: DataFrame, threshold: float, *, vector: str = "embedding", unique: str = "vec_id", block: int | None = None) -> DataFrame:
    """The ids of rows that are similar to one with a smaller id: the ``id_b`` of :func:`similar_pairs`, without the pairs."""
    members, groups = _groups(vectors, vector, unique)
    kind = groups.schema["first"].dataType.simpleString()

    def found(a, b, sims) -> pd.DataFrame:
        i, j = np.nonzero(sims >= threshold)
        (ka, fa), (kb, fb) = a, b
        up, down = np.unique(j[fa[i] < fb[j]]), np.unique(i[fb[j] < fa[i]])
        return pd.DataFrame({"key": np.concatenate([kb[up], ka[down]]), "first": np.concatenate([fb[up], fa[down]])})

    later = _compare(groups, threshold, block)(found, f"key binary, first {kind}").distinct()
    # a vector that has no equal comes with its id, a group of several members with its key
    whole = members.join(later.where("key is not null").select("key"), "key", "left_semi").select("id")
    whole = later.where("key is null").select(F.col("first").alias("id")).unionByName(whole)
    # of a group with equal members, all but the least id
    rest = members.join(_alike(groups, threshold).select("key", "first"), "key").where("id > first").select("id")
    return whole.unionByName(rest).distinct().withColumnRenamed("id", unique)


def _signatures(dim: int, tables: int, bits: int):
    """A vector's bucket in each table, as bytes of :func:`_bucket_type`."""
    p, kind = planes(dim, tables, bits), _bucket_type(bits)

    def run(vectors: pd.Series) -> pd.Series:
        m = np.stack([np.asarray(v, float) for v in vectors]) if len(vectors) else np.empty((0, dim))
        on = np.einsum("nd,tbd->ntb", m, p) > 0
        return pd.Series([x.tobytes() for x in (on * (1 << np.arange(bits))).sum(axis=2).astype(kind)], dtype=object)

    return F.pandas_udf(run, "binary")


def _bucket_type(bits: int) -> str:
    return "u1" if bits <= 8 else "i8"


def _norms(m: np.ndarray) -> np.ndarray:
    return np.sqrt(_dots(m, m))


def _dots(a: np.ndarray, b: np.ndarray, i=slice(None), j=slice(None)) -> np.ndarray:
    """Products of a's rows i and b's rows j, summed in the order of :func:`chronolith.functions.cosine`: equal to the last bit."""
    total = 0.0
    for d in range(a.shape[1]):
        total = total + a[i, d] * b[j, d]
    return total


def _best(q: np.ndarray, v: np.ndarray, allowed: Callable[[slice], np.ndarray], k: int, rank: np.ndarray, once: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of q, rows of v, similarities) of the k best rows of v for each of q, ties by ``rank``; ``once`` counts rows of
    one rank and similarity once. Matrix products choose, with a margin; what they choose is compared as Spark does it."""
    nq, nv = _norms(q), _norms(v)
    plain = lambda n: (n == 0) | ((n > 1e-100) & (n < 1e100))
    unit = lambda m, n: np.where(plain(n)[:, None], m / np.where(n > 0, n, 1.0)[:, None], 0.0)
    uq, uv, odd = unit(q, nq), unit(v, nv), ~plain(nv)
    q, v = np.asfortranarray(q), np.asfortranarray(v)
    take = k * (np.bincount(rank).max() if once else 1)
    for at in range(0, len(q), SEARCH_STRIP):
        strip = slice(at, at + SEARCH_STRIP)
        ok = allowed(strip)
        sims = np.where(ok & ~odd, uq[strip] @ uv.T, -np.inf)
        least = np.partition(sims, -take, axis=1)[:, -take] if take < len(v) else np.full(len(sims), -np.inf)
        i, j = np.nonzero(ok & ((sims >= least[:, None] - 1e-9) | odd | ~plain(nq[strip])[:, None]))
        i += at
        norm = nq[i] * nv[j]
        exact = np.where((norm > 0) | np.isnan(norm), _dots(q, v, i, j) / np.where(norm == 0, 1.0, norm), 0.0)
        falling = np.where(np.isnan(exact), -np.inf, -exact)
        order = np.lexsort((rank[j], falling, i))
        i, j, exact, falling = i[order], j[order], exact[order], falling[order]
        if once and len(i):
            new = np.r_[True, (i[1:] != i[:-1]) | (falling[1:] != falling[:-1]) | (rank[j][1:] != rank[j][:-1])]
            i, j, exact = i[new], j[new], exact[new]
        first = np.searchsorted(i, i)
        top = np.arange(len(i)) - first < k
        yield i[top], j[top], exact[top]


def search_blocks(asked: DataFrame, rows: DataFrame, k: int, meets: Callable[[np.ndarray, np.ndarray], np.ndarray], *, once: bool = False) -> DataFrame:
    """(query_id, id, similarity) of the k best rows for each query, without its own id.

    ``asked`` has query_id, v and tag, ``rows`` id, v and tag, all vectors of one length; ``meets`` takes the tags' bytes of
    some queries and some rows and says which may pair. Both are dealt by hash into blocks of bounded size; a task takes a
    block of each, and gives k rows for a query. ``once`` counts equal (query_id, id, similarity) once."""
    kind = rows.schema["id"].dataType.simpleString()
    of = asked.schema["query_id"].dataType.simpleString()

    value = {s: "f4" if df.schema["v"].dataType.simpleString() == "array<float>" else "f8" for s, df in (("q", asked), ("v", rows))}

    def packed(side: DataFrame, name: str, ids: list[str], kinds: str, n: int) -> DataFrame:
        # a value that is null makes the similarity 0, as a vector of zeros does
        v = F.when(F.exists("v", lambda x: x.isNull()), F.transform("v", lambda x: F.lit(0.0).cast(side.schema["v"].dataType.elementType))).otherwise(F.col("v"))

        def pack(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            m = np.array(g.v.tolist(), value[name])
            return pd.DataFrame({"b": [key[0]], **{c: [g[c].tolist()] for c in ids}, "n": [len(g)], "m": [m.tobytes()], "tags": [b"".join(g.tag)]})

        return side.select(F.pmod(F.xxhash64(ids[0], "v"), F.lit(n)).cast("int").alias("b"), *ids, v.alias("v"), "tag").groupBy("b").applyInPandas(pack, f"b int, {kinds}, n int, m binary, tags binary")

    asked = asked.where("query_id is not null").withColumn("own", F.col("query_id").try_cast(kind)).where("own is not null")
    rows = rows.where("id is not null")
    many, few = max(1, math.ceil(rows.count() / SEARCH_ROWS)), max(1, math.ceil(asked.count() / SEARCH_ASKED))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = packed(asked, "q", ["query_id", "own"], f"query_id array<{of}>, own array<{kind}>", few).withColumnRenamed("b", "x").withColumn("y", spread(many))
    right = packed(rows, "v", ["id"], f"id array<{kind}>", many).withColumnRenamed("b", "y").withColumn("x", spread(few))

    def compare(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        if not len(qs) or not len(vs):
            return none
        a, b = qs.iloc[0], vs.iloc[0]
        load = lambda r, side: np.frombuffer(r.m, value[side]).reshape(r.n, -1).astype(float)
        tags = lambda r: np.frombuffer(r.tags, np.uint8).reshape(r.n, -1)
        asked_ids, own, ids, qt, vt = np.asarray(a.query_id), np.asarray(a.own), np.asarray(b.id), tags(a), tags(b)
        rank = np.unique(np.concatenate([own, ids]), return_inverse=True)[1].ravel()
        mine, rank = rank[: a.n], rank[a.n :]
        allowed = lambda strip: meets(qt[strip], vt) & (mine[strip, None] != rank)
        found = [pd.DataFrame({"query_id": asked_ids[i], "id": ids[j], "similarity": s}) for i, j, s in _best(load(a, "q"), load(b, "v"), allowed, k, rank, once)]
        return pd.concat(found)

    scored = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(compare, f"query_id {of}, id {kind}, similarity double")
    scored = scored.distinct() if once else scored
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")


def lsh_search(vectors: DataFrame, queries: DataFrame, k: int, *, dim: int, tables: int = 24, bits: int = 5, vector: str = "embedding", unique: str = "vec_id") -> DataFrame:
    """Approximate search: rows that share a random-hyperplane bucket with the query, ranked by exact similarity.

    For tables that one pass can read whole; :class:`chronolith.operators.ann.Index` reads only the cells it probes. Blocks of
    queries and rows are compared by matrix products, without a row for each pair that shares a bucket."""
    sign, kind = _signatures(dim, tables, bits), _bucket_type(bits)
    side = lambda df, name: df.select(F.col(unique).alias(name), F.col(vector).alias("v"), sign(vector).alias("tag"))

    def meets(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
        a, b = (np.ascontiguousarray(t).view(kind).T.copy() for t in (asked, rows))
        shared = np.zeros((len(asked), len(rows)), bool)
        for x, y in zip(a, b):
            shared |= x[:, None] == y
        return shared

    return search_blocks(side(queries, "query_id"), side(vectors, "id"), k, meets, once=True)


_token = re.compile(r"[a-z0-9]+|[^\x00-\x7f]")


def _embedded(texts: pa.Array, dim: int) -> pa.Array:
    """The vectors of texts, of which EMBED_STRIP at a time are Python strings; the vectors are one array of numbers."""
    import xxhash

    hash_of = xxhash.xxh64_intdigest
    out = np.zeros((len(texts), dim))
    for at in range(0, len(texts), EMBED_STRIP):
        for k, t in enumerate(texts.slice(at, EMBED_STRIP).to_pylist(), at):
            words = _token.findall((t or "").lower())
            parts = itertools.chain(words, map(" ".join, zip(words, words[1:])), itertools.chain.from_iterable(words))
            sizes = [len(words), max(len(words) - 1, 0), sum(map(len, words))]
            weight = np.repeat([1.0, 1.5, 0.7], sizes)
            h = np.fromiter(map(hash_of, parts), np.uint64, sum(sizes))
            v = np.bincount((h % np.uint64(dim)).astype(np.int64), np.where(h >> np.uint64(63), weight, -weight), dim)
            n = np.linalg.norm(v)
            out[k] = v / n if n else v
    return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, dim, dtype="i4")), pa.array(out.ravel()))


def hash_embedding(text: Column, dim: int = 64) -> Column:
    """Normalised hashing embedding of words (1), word pairs (1.5) and characters (0.7)."""

    def run(texts: pa.Array) -> pa.Array:
        return _embedded(texts, dim)

    return F.arrow_udf(run, "array<double>")(text)
