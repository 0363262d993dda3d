"""Exact and approximate inner-product search for a batch of query vectors."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: So many queries go to every task at once; a larger set is gone through in blocks.
QUERY_BLOCK = 10_000
#: So many scores a task holds at once.
SCORES = 1 << 22


def _query_blocks(queries: DataFrame, size: int):
    """(ids, matrix) of ``size`` queries after another; the driver reads one partition at a time."""
    rows = queries.select("query_id", "vec").toLocalIterator()
    while own := list(islice(rows, size)):
        yield np.array([r["query_id"] for r in own], np.int64), np.array([r["vec"] for r in own], np.float64)


def _best(ids: np.ndarray, matrix: np.ndarray, top: int):
    """A task's own ``top`` rows for each query of a block; of equal scores the smaller id."""
    step = max(1, SCORES // len(ids))

    def best(batches):
        scores, found = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), np.int64)
        for batch in batches:
            for a in range(0, len(batch), step):
                part = batch.iloc[a : a + step]
                own = matrix @ np.array(part["vec"].tolist(), np.float64).T
                every = np.concatenate([scores, own], axis=1)
                which = np.concatenate([found, np.tile(part["vec_id"].to_numpy(), (len(ids), 1))], axis=1)
                order = np.lexsort((which, -every.round(9)), axis=1)[:, :top]
                scores, found = np.take_along_axis(every, order, 1), np.take_along_axis(which, order, 1)
        if found.shape[1]:
            yield pd.DataFrame({"query_id": np.repeat(ids, found.shape[1]), "vec_id": found.ravel(), "score": scores.ravel()})

    return best


def search(vectors: DataFrame, queries: DataFrame, top: int = 25, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` inner products of each query.

    The queries go to every task in blocks of ``query_block``, however many
    there are; a task multiplies its vectors with a block and keeps its own
    ``top``, so that only those rows are shuffled.
    """
    schema, local = "query_id long, vec_id long, score double", None
    for ids, matrix in _query_blocks(queries, query_block):
        found = vectors.select("vec_id", "vec").mapInPandas(_best(ids, matrix, top), schema)
        local = found if local is None else local.unionByName(found)
    if local is None:
        local = vectors.sparkSession.createDataFrame([], schema)
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("vec_id"))
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def train_cells(vectors: DataFrame, cells: int, seed: int = 7):
    """A coarse quantiser over unit vectors."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    return KMeans(k=cells, seed=seed, maxIter=10, featuresCol="features").fit(vectors.select(array_to_vector(F.col("vec").cast("array<double>")).alias("features")))


def cell_order(matrix: np.ndarray, centers: np.ndarray, probes: int | None = None) -> np.ndarray:
    """Each row's cells, the nearest first."""
    distance = (centers**2).sum(1) - 2 * matrix @ centers.T
    return np.argsort(distance, axis=1, kind="stable")[:, :probes].astype(np.int32)


def probes_needed(vectors: DataFrame, model, recall: float = 0.95, sample: int = 256, top: int = 25) -> int:
    """The fewest probes at which a sample of the vectors, asked against all, has ``recall`` of its exact ``top``."""
    from pyspark.ml.functions import array_to_vector

    centers = np.array(model.clusterCenters())
    asked = vectors.select(F.col("vec_id").alias("query_id"), "vec").orderBy(F.xxhash64("vec_id")).limit(sample)
    asked = vectors.sparkSession.createDataFrame([(r["query_id"], [float(x) for x in r["vec"]]) for r in asked.collect()], "query_id long, vec array<double>")
    found = search(vectors, asked, top).select("query_id", "vec_id").join(vectors.select("vec_id", "vec"), "vec_id")
    found = model.transform(found.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))).select("query_id", F.col("prediction").alias("cell"))
    rows = asked.collect()
    if not rows:
        return len(centers)
    order = cell_order(np.array([r["vec"] for r in rows]), centers)
    place = {r["query_id"]: np.argsort(own) for r, own in zip(rows, order)}
    depths = np.sort([place[r["query_id"]][r["cell"]] for r in found.collect()])
    return int(depths[int(np.ceil(recall * len(depths))) - 1]) + 1


def search_cells(vectors: DataFrame, queries: DataFrame, model, probes: int, top: int = 25) -> DataFrame:
    """Approximate search: each query meets the vectors of its ``probes`` nearest cells."""
    from pyspark.ml.functions import array_to_vector

    centers = np.array(model.clusterCenters())
    celled = model.transform(vectors.withColumn("features", array_to_vector(F.col("vec").cast("array<double>")))).select("vec_id", "vec", F.col("prediction").alias("cell"))

    @F.pandas_udf("array<int>")
    def near(vec: pd.Series) -> pd.Series:
        return pd.Series(list(cell_order(np.array(vec.tolist(), float), centers, probes)))

    from quillmark.functions.text import inner_product

    asked = queries.select("query_id", F.col("vec").alias("q"), F.explode(near("vec")).alias("cell"))
    scored = celled.join(asked, "cell").select("query_id", "vec_id", inner_product(F.col("vec"), F.col("q")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.col("vec_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
