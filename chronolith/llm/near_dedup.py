"""Near-duplicate classes by BagMinHash: signatures, banding, and exact multiset overlap.

Texts are told apart by a 128-bit digest, so exact copies are one node and cost nothing further. Nodes that
share a band's key are candidates. Every bucket has a hub, the member with most bucket mates; each member's
bag is compared with its hubs' bags exactly. Pairs of members that a hub does not link are compared in blocks,
each bag held as bits over the hub's bag plus its other shingles: matrix products of strips give a block's overlaps,
and a block returns no more links than it has rows. So every candidate pair is decided by its exact
similarity, large buckets are spread over tasks, and no list of all pairs is made. A block holds at most
``BLOCK_BYTES`` of bags, a strip's matrices a few ten MB. Classes are the connected components of the links.

Words are cut at ASCII white space and compared in lower case; a text of fewer than five words is one
shingle. Cases: null and empty texts are equal texts, one class; rows with a null id keep a null class; repeated
rows share a class; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolith.llm import bagminhash as bmh
from chronolith.llm.common import fresh, materialize, release_memory, using
from chronolith.llm.components import components

BANDS, ROWS = 26, 5  # a pair of similarity 0.8 shares a band with probability 0.99997
THRESHOLD = 0.8
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 512, 65_536, 16
BLOCK_BYTES = 32 << 20
LEFT_STRIP, RIGHT_STRIP = 256, 1024  # rows whose bits are unpacked at a time
OVERLAPS = 1 << 21  # common shingles outside the hub's that are added at a time
HUB_MEMBERS = 2048  # that meet one copy of a hub's text
SEEN = 200_000


def _digest(text):
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def band_table(rows: DataFrame) -> DataFrame:
    """(key, node) of every band of every text with a word; ``rows`` has node and text. Texts that a task has
    just seen are skipped, so most copies cost nothing; the others repeat the same pairs."""
    import pyarrow as pa

    def keys_of(batches: Iterator) -> Iterator:
        seen: set[bytes] = set()
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                new = []
                for i, node in enumerate(part.column(0).to_pylist()):
                    if node not in seen:
                        seen.add(node)
                        new.append(i)
                if len(seen) > SEEN:
                    seen.clear()
                part = part.take(pa.array(new, pa.int32()))
                bags = [bmh.bag(t) for t in part.column(1).to_pylist()]
                full = [i for i, b in enumerate(bags) if len(b[0])]
                if not full:
                    continue
                keys = bmh.band_keys(bmh.signatures([bags[i] for i in full], BANDS * ROWS), BANDS, ROWS)
                node = part.column(0).take(pa.array(np.repeat(full, BANDS)))
                yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), node], ["key", "node"])

    def run(batches: Iterator) -> Iterator:
        using("near dedup")
        yield from keys_of(batches)
        release_memory()  # the joins that follow need no Python for long

    return rows.select("node", "text").mapInArrow(run, "key long, node binary")


def _against_hub(text: str, hub: tuple) -> tuple[float, int, bytes, bytes]:
    """Similarity to the hub, size, bits over the hub's unit weights, and the other shingles (one for each unit)."""
    values, counts = bmh.bag(text)
    at = np.searchsorted(hub[0], values)
    at[at == len(hub[0])] = 0
    same = hub[0][at] == values
    common = np.zeros(len(hub[0]), np.int64)
    common[at[same]] = np.minimum(counts[same], hub[1][at[same]])
    rest = counts.copy()
    rest[same] -= common[at[same]]
    size, total = int(counts.sum()), int(hub[1].sum())
    overlap = int(common.sum())
    starts = np.concatenate([[0], np.cumsum(hub[1])[:-1]])
    unit = np.arange(total) - np.repeat(starts, hub[1]) < np.repeat(common, hub[1])
    order = np.concatenate([np.arange(n) for n in rest]) if len(rest) else np.empty(0)
    other = bmh.mix(np.repeat(values, rest) + order.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (overlap / (size + total - overlap) if size + total else 1.0), size, np.packbits(unit).tobytes(), other.tobytes()


def compare_with_hub(texts: pd.Series, hubs: pd.Series) -> pd.DataFrame:
    using("near dedup")
    last, held, rows = None, None, []
    for text, hub in zip(texts, hubs):
        if hub != last:
            last, held = hub, bmh.bag(hub)
        rows.append(_against_hub(text, held))
    return pd.DataFrame(rows, columns=["j", "size", "bits", "other"])


def _sorted_others(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """All rows' other shingles in order, and the row of each."""
    parts = [np.frombuffer(b, np.int64) for b in rows.other]
    values, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    order = np.argsort(values, kind="stable")
    return values[order], row[order]


def _add_common(block: np.ndarray, values: np.ndarray, row: np.ndarray, all_values: np.ndarray, all_rows: np.ndarray) -> None:
    """Adds one to ``block`` for each shingle that a row (``values``, ``row``) shares with a column."""
    low = np.searchsorted(all_values, values, "left")
    n = np.searchsorted(all_values, values, "right") - low
    some = n > 0
    low, n, row = low[some], n[some], row[some]
    ends = np.cumsum(n)
    at = 0
    while at < len(n):
        done = ends[at - 1] if at else 0
        to = max(int(np.searchsorted(ends, done + OVERLAPS, "right")), at + 1)
        k = n[at:to]
        column = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low[at:to], k)
        np.add.at(block, (np.repeat(row[at:to], k), all_rows[column]), 1)
        at = to


def _links_of_block(cell: pd.DataFrame) -> pd.DataFrame:
    """Links between the unlinked rows of a block (role 0) and its other rows, one for each class they join."""
    out = []
    left, right = cell[cell.role == 0], cell[cell.role == 1]
    if len(left) and len(right):
        bits = lambda rows: np.unpackbits(np.stack([np.frombuffer(b, np.uint8) for b in rows.bits]), axis=1).astype(np.float32)
        root = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        for first in range(0, len(right), RIGHT_STRIP):
            columns = right[first : first + RIGHT_STRIP]
            rbits, rsize, rnode, linked = bits(columns), columns["size"].to_numpy(), columns.node.to_numpy(), columns.linked.to_numpy()
            rvalues, rrows = _sorted_others(columns)
            for low in range(0, len(left), LEFT_STRIP):
                rows = left[low : low + LEFT_STRIP]
                lsize, lnode = rows["size"].to_numpy(), rows.node.to_numpy()
                block = bits(rows) @ rbits.T
                _add_common(block, *_sorted_others(rows), rvalues, rrows)
                both = lsize[:, None] + rsize
                for i, j in np.argwhere(block.astype(float) * (1 + THRESHOLD) >= THRESHOLD * both - 1e-6):
                    a, b = lnode[i], rnode[j]
                    if a == b:
                        continue
                    x, y = find(a), find(b"" if linked[j] else b)  # linked rows are one class already
                    if x != y:
                        root[max(x, y)] = min(x, y)
                        out.append((a, b))
    return pd.DataFrame(out, columns=["a", "b"])


def near_duplicate_links(rows: DataFrame, first: DataFrame) -> DataFrame:
    """Links (a, b) that connect the same nodes as all candidate pairs of similarity 0.8 or more do.

    ``rows`` has id, node and text of every document, ``first`` one (id, node) for each node."""
    bands = materialize(band_table(rows), "bands")
    mark = F.xxhash64("node")
    sizes = bands.groupBy("key").agg(F.count("*").alias("n"), F.min(mark).alias("low"), F.max(mark).alias("high")).where("low <> high")
    shared = materialize(bands.join(sizes.select("key", "n"), "key").distinct(), "buckets")
    degree = shared.groupBy("node").agg(F.sum("n").alias("degree"))
    hub = shared.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node")).alias("hub"))
    pairs = shared.select("key", "node").join(hub.select("key", F.col("hub.node").alias("hub")), "key").where("hub <> node").select("hub", "node").distinct()
    pairs = materialize(pairs, "pairs")
    wanted = pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).distinct().join(first, "node")
    # the same plan at every size: the texts are shuffled once
    texts = rows.join(wanted.hint("merge"), ["id", "node"], "left_semi").dropDuplicates(["id", "node"]).select("node", "text")
    texts = materialize(texts, "candidates")
    compare = F.pandas_udf(compare_with_hub, "struct<j double, size int, bits binary, other binary>")
    # a hub's text is repeated, so that no task has more than its share of a large hub's members
    copies = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("copies"))
    hubs = texts.withColumnRenamed("node", "hub").join(copies, "hub").select("hub", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), F.col("text").alias("hub_text"))
    dealt = pairs.join(copies, "hub").select("hub", "node", F.pmod(F.xxhash64("node"), F.col("copies")).cast("int").alias("copy"))
    joined = dealt.join(texts, "node").join(hubs, ["hub", "copy"])
    members = materialize(joined.select("hub", "node", compare("text", "hub_text").alias("c")).select("hub", "node", "c.*", (F.col("c.j") >= THRESHOLD).alias("linked")), "members")
    links = members.where("linked").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    # blocks of the hubs that leave two members undecided
    size = F.sum(F.octet_length("bits") + F.octet_length("other"))
    of_hub = members.groupBy("hub").agg(F.count("*").alias("n"), F.count_if(~F.col("linked")).alias("open"), size.alias("bytes")).where("open > 0 and n > 1")
    block = F.least(F.lit(MOST_BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.ceil(F.col("n") / BLOCKS)))
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int")
    rows = members.join(of_hub.select("hub", blocks.alias("blocks")), "hub").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.where("not linked").withColumn("y", every).withColumn("x", F.col("own")).withColumn("role", F.lit(0))
    right = rows.withColumn("x", every).withColumn("y", F.col("own")).withColumn("role", F.lit(1))
    cells = left.unionByName(right).select("hub", "x", "y", "role", "node", "size", "linked", "bits", "other")
    # dealt by block: rows that are already dealt by hub would stay in one task otherwise
    cells = cells.repartition("hub", "x", "y")
    return links.unionByName(cells.groupBy("hub", "x", "y").applyInPandas(_links_of_block, "a binary, b binary"))


def _classes(texts: DataFrame) -> DataFrame:
    """(node, kept, class_id): for each node of the rows (id, node, text) the least (id, node) of its class, and its id."""
    first = materialize(texts.where("id is not null").groupBy("node").agg(F.min("id").alias("id")), "first")
    roots = components(near_duplicate_links(texts.where("id is not null"), first))
    of_node = first.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = of_node.groupBy("root").agg(F.min(F.struct("id", "node")).alias("kept"))
    return of_node.join(least, "root").select("node", "kept", F.col("kept.id").alias("class_id"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), _digest(F.col(text_col)).alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``class_id``, the least id among the near copies, for every row."""
    texts = _texts(docs, id_col, text_col)
    rows = texts.select("id", "node")
    known = rows.where("id is not null").join(_classes(texts).select("node", "class_id"), "node").select("id", "class_id")
    kind = docs.schema[id_col].dataType
    unknown = rows.where("id is null").select("id", F.lit(None).cast(kind).alias("class_id"))
    return known.unionByName(unknown).withColumnRenamed("id", id_col)


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each class, the one with the least id (of equal ids, the least digest of its text; of rows that
    are equal in both, the one with the least hash of all columns). Different texts with the same id, in different classes,
    all stay, and so do rows without an id."""
    kept = _classes(_texts(docs, id_col, text_col)).select("kept.*").distinct()
    [node, row] = fresh(docs.columns, "_node", "_row")
    named = kept.select(F.col("id").alias(id_col), F.col("node").alias(node))
    whole = docs.where(F.col(id_col).isNotNull()).withColumn(node, _digest(F.col(text_col))).join(named, [id_col, node], "left_semi")
    of = F.struct(*docs.columns)
    one = whole.groupBy(id_col, node).agg(F.min_by(of, F.xxhash64(*docs.columns)).alias(row)).select(f"{row}.*")
    return one.unionByName(docs.where(F.col(id_col).isNull()))


def op2_query(spark, sf_dir: str) -> DataFrame:
    from chronolith.llm.common import table

    return near_duplicate_classes(table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH RECURSIVE texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL),
nodes AS (SELECT min(doc_id) AS node, text FROM texts GROUP BY text),
words AS (SELECT node, list_filter(regexp_split_to_array(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM nodes),
shingles AS (SELECT node, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words WHERE len(w) > 0),
bags AS (SELECT node, s, count(*) AS c FROM shingles GROUP BY node, s),
sizes AS (SELECT node, sum(c) AS n FROM bags GROUP BY node),
common AS (SELECT x.node AS a, y.node AS b, sum(least(x.c, y.c)) AS o FROM bags x JOIN bags y ON x.s = y.s AND x.node < y.node GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN sizes p ON p.node = a JOIN sizes q ON q.node = b WHERE o >= 0.8 * (p.n + q.n - o) - 1e-9),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, root) AS (SELECT node, node FROM nodes UNION SELECT e.b, r.root FROM reach r JOIN both_ways e ON e.a = r.node WHERE r.root < e.b),
roots AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT t.doc_id, r.root AS class_id FROM texts t JOIN nodes n ON n.text = t.text JOIN roots r ON r.node = n.node
UNION ALL SELECT doc_id, NULL FROM documents WHERE doc_id IS NULL
"""
