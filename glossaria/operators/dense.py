"""Dense vector collections: exact and approximate nearest neighbours, upserts, paging.

Exact search multiplies blocks: tiles of the entries against tiles of the
query matrix. Queries are sent to the tasks in blocks of about ``BLOCK`` rows.
Every Arrow batch keeps its own best k, so what is shuffled grows with batches
times k, not with pairs. Approximate search routes queries to the cells of a
k-means partition, whose number grows with the entries, and multiplies within
cells, cut into pieces of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glossaria.functions import vectors
from glossaria.scratch import materialise

BLOCK = 4096
#: Rows of queries and of entries that are multiplied at once.
TILE_QUERIES, TILE_ENTRIES = 256, 8192
#: Entries of a cell that meet its queries in one task, about.
PIECE = 20_000
MAX_CELLS = 4096
#: Queries whose exact neighbours tell how many cells must be probed, and the share of the neighbours that these must hold.
CALIBRATE, HELD = 64, 0.96


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), vectors.FLOOR) if m.size else m


def _best(q_unit: np.ndarray, e_unit: np.ndarray, order: np.ndarray, k: int, digits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, entry rows and scores of the best ``k`` entries of each query; ties go to the smaller ``order``."""
    at_q, at_e, found = [], [], []
    for a in range(0, len(q_unit), TILE_QUERIES):
        some = q_unit[a : a + TILE_QUERIES]
        for b in range(0, len(e_unit), TILE_ENTRIES):
            score = (some @ e_unit[b : b + TILE_ENTRIES].T).round(digits) + 0.0
            n = score.shape[1]
            least = np.partition(score, n - k, axis=1)[:, n - k] if n > k else np.full(len(some), -np.inf)
            for i, row in enumerate(score):
                hit = np.flatnonzero(row >= least[i])
                hit = hit[np.lexsort((order[b + hit], -row[hit]))[:k]]
                at_q.append(np.full(len(hit), a + i))
                at_e.append(b + hit)
                found.append(row[hit])
    return (np.concatenate(at_q), np.concatenate(at_e), np.concatenate(found)) if at_q else (np.zeros(0, int),) * 2 + (np.zeros(0),)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entry_id"))).filter(F.col("rank") <= k)


def _order(ids: pa.Array) -> np.ndarray:
    """The place of each id among them in ascending order."""
    place = np.empty(len(ids), np.int64)
    place[pa.compute.array_sort_indices(ids).to_numpy()] = np.arange(len(ids))
    return place


def _hits(queries: DataFrame, entries: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", queries.schema["query_id"].dataType), T.StructField("entry_id", entries.schema["entry_id"].dataType), T.StructField("score", T.DoubleType())])


def top_k(queries: DataFrame, entries: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """query_id, entry_id, score (cosine, rounded), rank.

    ``queries``: query_id, vector; ``entries``: entry_id, vector. Ties go to the smaller entry_id.
    """
    numbered = queries.select("query_id", "vector").filter("vector is not null")
    blocks = max(1, -(-numbered.count() // BLOCK))
    kind, out = _hits(queries, entries), None
    for b in range(blocks):
        part = numbered if blocks == 1 else numbered.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = part.toArrow().combine_chunks()  # one block of queries, about BLOCK rows
        ids = rows.column(0).combine_chunks() if rows.num_rows else rows.column(0)
        unit = _unit(_matrix(rows.column(1).combine_chunks())) if rows.num_rows else np.zeros((0, 0))

        def run(batches, ids=ids, unit=unit):
            for batch in batches:
                if len(ids) and batch.num_rows:
                    e = batch.column(0)
                    q, at, score = _best(unit, _unit(_matrix(batch.column(1))), _order(e), k, digits)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(q)), e.take(pa.array(at)), pa.array(score)], names=["query_id", "entry_id", "score"])

        found = entries.select("entry_id", "vector").filter("vector is not null").mapInArrow(run, kind)
        out = found if out is None else out.unionByName(found)
    return _ranked(out, k)


def top_k_filtered(queries: DataFrame, entries: DataFrame, k: int, where: dict[str, object]) -> DataFrame:
    """``top_k`` among the entries whose columns equal ``where``; the filter goes before the search."""
    for column, value in where.items():
        entries = entries.filter(F.col(column) == F.lit(value))
    return top_k(queries, entries, k)


def top_k_cells(queries: DataFrame, entries: DataFrame, k: int, cells: int | None = None, probes: int | None = None, sample: int = 20_000, seed: int = 5) -> DataFrame:
    """Approximate ``top_k``: k-means cells of the entries, each query compared within its nearest ``probes``.

    The cells' centres are fitted on at most about ``sample`` entries; every
    entry is indexed. There are about as many cells as the root of the entries
    (``MAX_CELLS`` at most) unless it is given. Without ``probes`` the exact
    neighbours of ``CALIBRATE`` queries are looked up, and as many cells are
    probed as hold the share ``HELD`` of them.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    unit = entries.select("entry_id", "vector").filter("vector is not null")
    n = unit.count()
    if not n:
        return _ranked(queries.select("query_id", "vector").mapInArrow(lambda batches: iter(()), _hits(queries, entries)), k)
    fit = unit if n <= sample else unit.sample(sample / n, seed)
    cells = cells or max(8, min(MAX_CELLS, round(n**0.5)))
    model = KMeans(k=cells, seed=seed, featuresCol="f", predictionCol="cell").fit(fit.select(array_to_vector(vectors.normalised(F.col("vector"))).alias("f")))
    centres = _unit(np.array(model.clusterCenters()))  # at most MAX_CELLS rows

    def routed(rows: DataFrame, key: str, most: int) -> DataFrame:
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    near = np.argsort(-(_unit(_matrix(batch.column(1))) @ centres.T), axis=1, kind="stable")[:, :most]
                    at = pa.array(np.repeat(np.arange(batch.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(near.ravel().astype(np.int32))], names=[key, "vector", "cell"])

        source = rows.select(key, "vector").filter("vector is not null")
        return source.mapInArrow(run, T.StructType([*source.schema.fields, T.StructField("cell", T.IntegerType())]))

    placed = materialise(routed(unit, "entry_id", 1), "dense-cells")
    if probes is None:
        some = materialise(queries.filter("vector is not null").select("query_id", "vector").orderBy(F.xxhash64("query_id"), "query_id").limit(CALIBRATE), "dense-calibrate")
        near = top_k(some, unit, k).join(placed.select("entry_id", F.col("cell").alias("home")), "entry_id").select("query_id", "home")
        order = routed(some, "query_id", cells).groupBy("query_id").agg(F.collect_list("cell").alias("order"))  # a row lists its cells from the nearest
        depth = near.join(order, "query_id").select(F.array_position("order", F.col("home")).alias("depth"))
        probes = max(1, round(depth.agg(F.percentile("depth", HELD)).first()[0] or 1))
    pieces = placed.groupBy(F.col("cell").alias("_cell")).agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"))
    cut = F.broadcast(pieces)  # a row for each cell, at most MAX_CELLS
    asked = routed(queries, "query_id", probes).join(cut, F.col("cell") == F.col("_cell")).select("query_id", "vector", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    held = placed.join(cut, F.col("cell") == F.col("_cell")).select("entry_id", "vector", "cell", F.pmod(F.xxhash64("entry_id"), F.col("pieces")).cast("int").alias("piece"))

    def compare(q: pa.Table, e: pa.Table) -> pa.Table:
        if not q.num_rows or not e.num_rows:
            return pa.Table.from_arrays([q.column(0).slice(0, 0), e.column(0).slice(0, 0), pa.array([], pa.float64())], names=["query_id", "entry_id", "score"])
        ids = e.column(0).combine_chunks()
        a, b, score = _best(_unit(_matrix(q.column(1).combine_chunks())), _unit(_matrix(e.column(1).combine_chunks())), _order(ids), k, 6)
        return pa.Table.from_arrays([q.column(0).take(pa.array(a)), ids.take(pa.array(b)), pa.array(score)], names=["query_id", "entry_id", "score"])

    return _ranked(asked.groupBy("cell", "piece").cogroup(held.groupBy("cell", "piece")).applyInArrow(compare, _hits(queries, entries)), k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n_exact, n_found: the exact neighbours, and how many of them ``found`` has."""
    same = exact.select("query_id", "entry_id").join(found.select("query_id", "entry_id", F.lit(1).alias("hit")), ["query_id", "entry_id"], "left")
    return same.agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))


class Collections:
    """Named vector collections (entry_id, vector, payload columns) as tables below a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        at, fs = self._at(name)
        return fs.exists(at)

    def create(self, name: str, rows: DataFrame) -> None:
        if self.exists(name):
            raise ValueError(f"collection {name} exists")
        rows.write.parquet(f"{self.path}/{name}")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Put ``rows``, which may read the collection, in its place."""
        rows = materialise(rows, "collection")
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def read(self, name: str, with_vectors: bool = True) -> DataFrame:
        if not self.exists(name):
            raise KeyError(name)
        rows = self.spark.read.parquet(f"{self.path}/{name}")
        return rows if with_vectors else rows.drop("vector")

    def delete(self, name: str) -> bool:
        """Whether there was one."""
        at, fs = self._at(name)
        return fs.delete(at, True)

    def names(self) -> list[str]:
        at, fs = self._at("")
        return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []

    def info(self, name: str) -> DataFrame:
        """collection, entries, dimensions."""
        return self.read(name).agg(F.lit(name).alias("collection"), F.count(F.lit(1)).alias("entries"), F.max(F.size("vector")).alias("dimensions"))

    def get(self, name: str, ids: DataFrame, with_vectors: bool = False) -> DataFrame:
        """The entries of ``ids`` (entry_id); unknown ones have no row."""
        return self.read(name, with_vectors).join(ids.select("entry_id").distinct(), "entry_id")


def upsert(collection: DataFrame, new: DataFrame, key: str = "entry_id") -> DataFrame:
    """Rows of ``new`` replace rows of equal key; vectors of another length are refused."""
    sizes = collection.select(F.size("vector").alias("n")).limit(1).collect()
    if sizes:
        wrong = new.filter(F.size("vector") != sizes[0]["n"]).limit(1).count()
        if wrong:
            raise ValueError(f"vectors of this collection have {sizes[0]['n']} dimensions")
    return collection.join(new.select(key), key, "left_anti").unionByName(new)


def delete(collection: DataFrame, ids: DataFrame, key: str = "entry_id") -> DataFrame:
    return collection.join(ids.select(key), key, "left_anti")


def page(collection: DataFrame, after: int | None, limit: int, key: str = "entry_id") -> DataFrame:
    """The next ``limit`` rows by key."""
    rows = collection if after is None else collection.filter(F.col(key) > after)
    return rows.orderBy(key).limit(limit)


def distances(a: Column, b: Column) -> dict[str, Column]:
    return {"cosine": vectors.cosine(a, b), "dot": vectors.dot(a, b), "euclidean": vectors.euclidean(a, b)}
