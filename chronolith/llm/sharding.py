"""Shards by extendible hashing: a directory over the leading bits of the key's hash.

A bucket is a prefix of hash bits. Only a bucket whose rows exceed the byte limit is split on another bit, until
every shard fits. The bytes of all rows are summed once by a fine prefix; sums over shorter prefixes decide how
many bits each shard needs. Rows whose fine bucket is still too large go on with further bits: of the key's hash
while the bucket has several keys, else of a hash of key and text, and where rows are equal, of a row number. So
a hot key is split at once, and rounds go on until every row has its shard. A single row above the limit is a
shard of its own. :func:`directory` lists the shards.

Sizes and hashes are taken before the first shuffle: the text moves only if the caller keeps it.

Cases: null keys and texts are hashed as empty ones; repeated rows may fall into different shards once their
bucket is too large; ties do not matter; an empty table gives no rows; extra columns are kept, whatever their
names, but for those of the added columns' names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolith.llm.common import fresh, materialize

LIMIT = 1 << 20
MOST_BITS = 24  # of one round: bounds the fine buckets
ADDED = ("shard", "depth", "doc_bytes", "shard_bytes")


def _bits(base: Column, k: int) -> Column:
    """32 bits of a hash of ``base``, others in each round."""
    digest = F.md5((base if k == 0 else F.concat(base, F.lit(f":{k}"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def assign_shards(docs: DataFrame, *, key_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Adds ``shard`` (its hash prefix as bits), ``depth`` (their number), ``doc_bytes`` and ``shard_bytes``."""
    kept = [c for c in docs.columns if c not in ADDED]
    key, body, size, prefix, kind, row, fine, place = fresh([*docs.columns, "d", "p", "b", "bytes"], "_key", "_body", "_size", "_prefix", "_kind", "_row", "_fine", "_place")
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.coalesce(F.col(key_col).cast("string"), F.lit(""))
    # the key as text, key and text as a hash, and what the bits are taken from: 0 the key, 1 key and text, 2 the row
    columns = {key: name, body: F.md5(F.concat_ws("\n", name, text).cast("binary")), size: F.octet_length(text).cast("long"), prefix: F.lit(""), kind: F.lit(0), row: F.lit(0).cast("long")}
    left = docs.select(*kept, *[c.alias(n) for n, c in columns.items()])
    names = [F.col(c) for c in kept]
    done: list[DataFrame] = []
    k = 0
    while True:
        largest = left.groupBy(prefix).agg(F.sum(size).alias("b")).agg(F.max("b")).first()[0]
        if largest is None:
            break
        bits = min(MOST_BITS, 3 + max(math.ceil(math.log2(max(largest, 1) / limit)), 0))
        base = F.col(key) if k == 0 else F.when(F.col(kind) == 0, F.col(key)).when(F.col(kind) == 1, F.col(body)).otherwise(F.col(row).cast("string"))
        rows = left.withColumn(fine, F.shiftright(_bits(base, k), 32 - bits))
        buckets = rows.groupBy(prefix, fine).agg(F.sum(size).alias("b"), (F.min(key) != F.max(key)).alias("keys"), (F.min(body) != F.max(body)).alias("texts"))
        depths = buckets.select("*", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("d")).withColumn("p", F.expr(f"shiftright({fine}, {bits} - d)"))
        fits = depths.groupBy(prefix, "d", "p").agg(F.sum("b").alias("bytes")).where(F.col("bytes") <= limit)
        # the shortest prefix that fits, for each fine bucket, or how to go on
        found = depths.join(fits, [prefix, "d", "p"], "left").groupBy(prefix, fine).agg(
            F.min(F.when(F.col("bytes").isNotNull(), F.struct("d", "bytes"))).alias("m"), F.when(F.any_value("keys"), 0).when(F.any_value("texts"), 1).otherwise(2).alias("next")
        )
        placed = rows.join(found.select(prefix, fine, F.struct("m", "next").alias(place)), [prefix, fine])
        of = F.expr(f"substring(lpad(bin({fine}), {bits}, '0'), 1, {place}.m.d)")
        done.append(placed.where(F.col(f"{place}.m").isNotNull()).select(*names, F.concat(prefix, of).alias("shard"), F.col(size).alias("doc_bytes"), F.col(f"{place}.m.bytes").alias("shard_bytes")))
        rest = placed.where(F.col(f"{place}.m").isNull()).select(
            *names, key, body, size, F.concat(prefix, F.expr(f"lpad(bin({fine}), {bits}, '0')")).alias(prefix), F.col(f"{place}.next").alias(kind), F.col(row) if k else F.monotonically_increasing_id().alias(row)
        )
        if k == 0 and not rest.select(prefix).take(1):
            break
        # written, so that a lost executor cannot number the rows anew
        rest = materialize(rest, "oversized")
        alone = rest.where(F.col(size) > limit)
        done.append(alone.select(*names, F.concat(prefix, F.lit("-"), F.col(row).cast("string")).alias("shard"), F.col(size).alias("doc_bytes"), F.col(size).alias("shard_bytes")))
        left = rest.where(F.col(size) <= limit)
        k += 1
    if not done:
        done = [left.select(*names, F.lit("").alias("shard"), F.col(size).alias("doc_bytes"), F.col(size).alias("shard_bytes"))]
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    depth = F.length(F.substring_index("shard", "-", 1)).cast("int")
    return out.select(*kept, "shard", depth.alias("depth"), "doc_bytes", "shard_bytes")


def directory(sharded: DataFrame) -> DataFrame:
    """One row for each shard: its bits, their number, its bytes and its rows."""
    return sharded.groupBy("shard").agg(F.any_value("depth").alias("depth"), F.sum("doc_bytes").alias("shard_bytes"), F.count("*").alias("n_docs"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Writes each shard's rows together, as Parquet partitions by shard."""
    sharded.repartition("shard").write.partitionBy("shard").parquet(path)


def op8_query(spark, sf_dir: str) -> DataFrame:
    from chronolith.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return assign_shards(docs).select("doc_id", "shard", "depth", "doc_bytes", "shard_bytes")


OP8_SQL = f"""
WITH d AS (SELECT doc_id, strlen(coalesce(text, '')) AS b, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM documents),
levels AS (SELECT k, h >> (32 - k) AS p, sum(b) AS bytes FROM d, range(0, 25) AS r(k) GROUP BY 1, 2 HAVING sum(b) <= {LIMIT}),
placed AS (SELECT d.doc_id, d.b, d.h, min(l.k) AS k FROM d JOIN levels l ON l.p = d.h >> (32 - l.k) GROUP BY d.doc_id, d.b, d.h)
SELECT p.doc_id, substr(lpad(bin(p.h), 32, '0'), 1, p.k::INT) AS shard, p.k::INT AS depth, p.b::BIGINT AS doc_bytes, l.bytes::BIGINT AS shard_bytes
FROM placed p JOIN levels l ON l.k = p.k AND l.p = p.h >> (32 - p.k)
"""
