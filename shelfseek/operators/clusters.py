"""Approximate vector search: a stored index of cluster lists, probing, and recall."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfseek.functions.vectors import l2_normalize
from shelfseek.operators.vector import _unit_rows
from shelfseek.session import ship_package

# Fixed value: number of lists.
LISTS = 100
FILE_BYTES = 128 << 20


def unit_rows(rows: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(length > 0, length, 1)


def train(embeddings: DataFrame, lists: int = LISTS, seed: int = 1, iterations: int = 10
          ) -> np.ndarray:
    """Unit cluster centres, trained on all vectors that have a direction."""
    points = embeddings.select(l2_normalize(F.col("embedding")).alias("v")).filter(
        F.col("v").isNotNull()).select(array_to_vector("v").alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=iterations).fit(points)
    return unit_rows(np.array(model.clusterCenters()))


def assign(embeddings: DataFrame, centres: np.ndarray) -> DataFrame:
    """(product_id, embedding, list_no); vectors without a direction are left out."""
    ship_package(embeddings.sparkSession)
    shipped = embeddings.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            unit = _unit_rows(batch.column("embedding"), shipped.value.shape[1])
            near = np.nan_to_num(unit, nan=0.0) @ shipped.value.T
            known = pa.array(~np.isnan(unit[:, 0]) if len(unit) else np.array([], dtype=bool))
            numbered = batch.append_column("list_no", pa.array(near.argmax(axis=1).astype("int32")))
            yield numbered.filter(known)

    return embeddings.select("product_id", "embedding").mapInArrow(
        run, "product_id string, embedding array<float>, list_no int")


def store_lists(embeddings: DataFrame, centres: np.ndarray, path: str) -> DataFrame:
    """Write the vectors in one folder per list, so that a probe reads the lists it asks for.

    Lists are cut into files by size; one that holds a large share of all
    vectors is written by many tasks.
    """
    numbered = assign(embeddings, centres)
    # One row per list.
    files = F.ceil(F.count("*") * (4 * centres.shape[1] + 32) / FILE_BYTES).alias("_files")
    sizes = numbered.groupBy("list_no").agg(files)
    (numbered.join(F.broadcast(sizes), "list_no")
     .withColumn("_file", F.pmod(F.xxhash64("product_id"), F.col("_files")))
     .repartition("list_no", "_file").drop("_file", "_files")
     .write.mode("errorifexists").partitionBy("list_no").parquet(path))
    return open_lists(embeddings.sparkSession, path)


def open_lists(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("product_id string, embedding array<float>, list_no int").parquet(path)


def nearest_lists(queries: DataFrame, centres: np.ndarray, probes: int) -> DataFrame:
    """(q_id, list_no): the ``probes`` nearest lists of each query with a direction."""
    ship_package(queries.sparkSession)
    shipped = queries.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            batch = batch.filter(batch.column("q_embedding").is_valid())
            unit = _unit_rows(batch.column("q_embedding"), shipped.value.shape[1])
            known = np.flatnonzero(~np.isnan(unit[:, 0])) if len(unit) else np.array([], dtype=int)
            order = np.argsort(-(unit[known] @ shipped.value.T), axis=1, kind="stable")[:, :probes]
            yield pa.RecordBatch.from_arrays(
                [batch.column("q_id").take(pa.array(np.repeat(known, order.shape[1]))),
                 pa.array(order.reshape(-1).astype("int32"))], names=["q_id", "list_no"])

    return queries.select("q_id", "q_embedding").mapInArrow(run, "q_id string, list_no int")


def scanned(probed: DataFrame, vectors: DataFrame) -> DataFrame:
    """(q_id, scanned): how many vectors the lists of each query hold."""
    sizes = vectors.groupBy("list_no").agg(F.count("*").alias("n"))
    return probed.join(sizes, "list_no").groupBy("q_id").agg(F.sum("n").alias("scanned"))


def recall(exact: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """(q_id, wanted, hit, recall) over the first ``k`` ranks of the exact answer."""
    wanted = exact.filter(F.col("rank") <= k).select("q_id", "product_id")
    got = found.filter(F.col("rank") <= k).select("q_id", "product_id", F.lit(1).alias("got"))
    return (wanted.join(got, ["q_id", "product_id"], "left").groupBy("q_id")
            .agg(F.count("*").alias("wanted"), F.count("got").alias("hit"))
            .withColumn("recall", F.col("hit") / F.col("wanted")))
