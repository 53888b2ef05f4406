"""An inverted-file index for approximate vector search: cells around centroids, as Parquet partitions.

Centroids are fitted on a bounded sample; every row is indexed. A search probes the cells whose centroids are nearest
to a query and ranks their rows by exact similarity. Rows are appended and deleted without building anew; a deleted id is
left out of every search, also one that was inserted again under the same id before :meth:`Index.vacuum`."""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolith.operators.vectors import search_blocks

SAMPLE = 20_000  # rows that centroids are fitted on


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Directions that the sample's rows gather around (spherical k-means)."""
    rows = _unit(sample[np.isfinite(sample).all(axis=1)])
    centers = rows[np.random.default_rng(seed).permutation(len(rows))[:cells]]
    for _ in range(rounds):
        own = (rows @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, rows)
        filled = np.linalg.norm(sums, axis=1) > 0
        centers = np.where(filled[:, None], _unit(sums), centers)
    return centers


def _nearest(centers: np.ndarray, n: int):
    def run(vectors: pd.Series) -> pd.Series:
        found = []
        for v in vectors:
            u = np.asarray(v, float)
            found.append(np.argsort(-(centers @ u), kind="stable")[:n].tolist() if len(u) == centers.shape[1] and np.isfinite(u).all() else [])
        return pd.Series(found, dtype=object)

    return F.pandas_udf(run, "array<int>")


class Index:
    """An index under a path that all executors reach. Rows without a vector of the index's length are not indexed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        row = spark.read.parquet(f"{path}/centroids").first()
        self.centers, self.vector, self.unique = np.array(json.loads(row.centers)), row.vector, row.unique

    @classmethod
    def build(cls, vectors: DataFrame, path: str, *, cells: int | None = None, vector: str = "embedding", unique: str = "vec_id", sample: int = SAMPLE) -> Index:
        """Fits centroids (by default the square root of the rows, 4096 at most) and writes all rows."""
        spark = vectors.sparkSession
        some = vectors.where(F.col(vector).isNotNull()).select(unique, vector)
        n = some.count()
        if not n:
            raise ValueError("no vectors to index")
        dim = some.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first().d
        rows = some.where(F.size(vector) == dim).orderBy(F.xxhash64(unique), unique).limit(sample).collect()  # bounded by sample
        centers = fit_centroids(np.array([r[1] for r in rows], float), cells or max(1, min(4096, math.isqrt(n))))
        spark.createDataFrame([(json.dumps(centers.tolist()), vector, unique)], "centers string, vector string, unique string").coalesce(1).write.parquet(f"{path}/centroids")
        index = cls(spark, path)
        index.insert(vectors)
        return index

    def insert(self, vectors: DataFrame) -> None:
        cell = F.get(_nearest(self.centers, 1)(self.vector), 0)
        placed = vectors.where(F.col(self.vector).isNotNull()).withColumn("cell", cell).where("cell is not null")
        placed.repartitionByRange("cell", self.unique).write.mode("append").partitionBy("cell").parquet(f"{self.path}/rows")

    def delete(self, ids: DataFrame) -> None:
        ids.select(self.unique).distinct().write.mode("append").parquet(f"{self.path}/deleted")

    def rows(self) -> DataFrame:
        """The rows that are not deleted, with their cell."""
        found = self.spark.read.parquet(f"{self.path}/rows")
        gone = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/deleted")
        if not gone.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(gone):
            return found
        return found.join(self.spark.read.parquet(f"{self.path}/deleted").distinct(), self.unique, "left_anti")

    def vacuum(self, path: str) -> Index:
        """Writes the rows that are left as an index of their own."""
        self.spark.read.parquet(f"{self.path}/centroids").write.parquet(f"{path}/centroids")
        self.rows().repartitionByRange("cell", self.unique).write.partitionBy("cell").parquet(f"{path}/rows")
        return Index(self.spark, path)

    def search(self, queries: DataFrame, k: int, *, probes: int = 8, query_id: str = "query_id", query: str = "query") -> DataFrame:
        """(query_id, id, similarity) of the k best rows of the probed cells, without the query's own id.

        Blocks of queries and rows meet in matrix products, without a row for each query and cell. Few queries read only the
        cells that one of them probes."""
        count = len(self.centers)

        def bits(cells: pd.Series) -> pd.Series:
            on = np.zeros((len(cells), count), bool)
            for row, probed in zip(on, cells):
                row[probed] = True
            return pd.Series([x.tobytes() for x in np.packbits(on, axis=1, bitorder="little")], dtype=object)

        def own(cells: pd.Series) -> pd.Series:
            return pd.Series([x.tobytes() for x in cells.to_numpy("i4")], dtype=object)

        def meets(asked: np.ndarray, rows: np.ndarray) -> np.ndarray:
            return np.unpackbits(asked, axis=1, count=count, bitorder="little").astype(bool)[:, rows.view("i4").ravel()]

        asked = queries.select(F.col(query_id).alias("query_id"), F.col(query).alias("v")).withColumn("cells", _nearest(self.centers, probes)("v"))
        wanted = [r.cell for r in asked.select(F.explode("cells").alias("cell")).distinct().collect()]  # at most all cells
        asked = asked.where(F.size("cells") > 0).select("query_id", "v", F.pandas_udf(bits, "binary")("cells").alias("tag"))
        rows = self.rows().where(F.col("cell").isin(wanted)) if len(wanted) < count else self.rows()
        rows = rows.select(F.col(self.unique).alias("id"), F.col(self.vector).alias("v"), F.pandas_udf(own, "binary")("cell").alias("tag"))
        return search_blocks(asked, rows, k, meets)
