"""Nearest neighbours over coded cluster lists, pruned by bounds that keep the answer exact.

Vectors lie in lists around trained centres as one byte a component. Two bounds
spare work, and neither can lose a neighbour:

* On unit vectors angles obey the triangle inequality: no member of a list is
  closer to the query than the query's angle to the centre less the list's
  widest angle (or its narrowest less the query's). Lists that cannot reach the
  k-th similarity found so far are not read.
* A code differs from its vector by a vector of stored length, its slack, so
  the similarity lies within the slack of the coded one. Only rows whose upper
  end reaches the k-th lower end are compared as full vectors.

How much the first bound spares depends on how the vectors cluster; the second
holds for any vectors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfseek.functions import ladders
from shelfseek.functions.vectors import cosine_similarity
from shelfseek.operators.clusters import FILE_BYTES
from shelfseek.operators.joins import local_table, top_k
from shelfseek.operators.vector import CELL_VECTORS, MAX_QUERY_BLOCK, NO_DATE, _unit_rows
from shelfseek.session import ship_package
from shelfseek.sources.tables import stored

#: Components are coded in so many steps on either side of zero.
STEPS = 127
#: More than floating point can be off by, and than similarities are rounded by.
MARGIN = 1e-5
#: Query and vector pairs compared at once.
BLOCK_CELLS = 4_000_000

CODES_DDL = ("product_id string, updated_us long, code binary, step double, slack double, same long, angle double, "
             "list_no int")
HITS_DDL = "q_id string, product_id string, lower double, upper double"


@dataclass
class CodedLists:
    """Stored codes, and of each list its centre, narrowest and widest angle, and size."""
    codes: DataFrame
    centres: np.ndarray
    low: np.ndarray
    high: np.ndarray
    count: np.ndarray

    def visited(self, unit: np.ndarray, floor: np.ndarray) -> np.ndarray:
        """Queries x lists: whether a list may hold a similarity of the query's floor or more."""
        angle = np.arccos(np.clip(unit @ self.centres.T, -1, 1))
        apart = np.maximum(0, np.maximum(angle - self.high, self.low - angle))
        return (np.cos(apart) >= floor[:, None] - MARGIN) & (self.count > 0)

    def first(self, unit: np.ndarray, k: int) -> np.ndarray:
        """Queries x lists: the nearest lists that hold ``k`` vectors together."""
        order = np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")
        before = np.cumsum(self.count[order], axis=1) - self.count[order]
        chosen = np.zeros(order.shape, dtype=bool)
        np.put_along_axis(chosen, order, before < k, axis=1)
        return chosen & (self.count > 0)


def code_rows(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of unit vectors, the size of a step, and the length of what a code leaves out."""
    step = np.abs(unit).max(axis=1, initial=0) / STEPS
    step[step == 0] = 1
    code = np.rint(unit / step[:, None]).astype(np.int8)
    return code, step, np.linalg.norm(unit - code * step[:, None], axis=1)


def coded(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """``CODES_DDL`` of ``product_id, embedding, updated_at``; vectors without a direction are left out.

    ``same`` tells equal vectors apart from others.
    """
    ship_package(vectors.sparkSession)
    shipped = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        for batch in batches:
            unit = _unit_rows(batch.column("embedding"), shipped.value.shape[1])
            known = np.flatnonzero(~np.isnan(unit[:, 0])) if len(unit) else np.array([], dtype=int)
            unit = unit[known]
            near = unit @ shipped.value.T
            code, step, slack = code_rows(unit)
            own = near.max(axis=1) if len(near) else np.array([])
            rows = batch.take(pa.array(known, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [rows.column("product_id"), rows.column("updated_us"), pa.array([c.tobytes() for c in code], pa.binary()),
                 pa.array(step), pa.array(slack), rows.column("same"), pa.array(np.arccos(np.clip(own, -1, 1))),
                 pa.array(near.argmax(axis=1).astype("int32") if len(near) else [], pa.int32())],
                names=["product_id", "updated_us", "code", "step", "slack", "same", "angle", "list_no"])

    return vectors.select("product_id", "embedding", F.unix_micros("updated_at").alias("updated_us"),
                          F.xxhash64("embedding").alias("same")).mapInArrow(run, CODES_DDL)


def store(vectors: DataFrame, centres: np.ndarray, path: str) -> CodedLists:
    """Write the codes in one folder per list, cut into files by size, and what bounds each list."""
    spark = vectors.sparkSession
    rows = stored(coded(vectors, centres), "codes")
    files = F.ceil(F.count("*") * (centres.shape[1] + 64) / FILE_BYTES).alias("files")
    # One row per list.
    lists = rows.groupBy("list_no").agg(F.min("angle").alias("low"), F.max("angle").alias("high"),
                                        F.count("*").alias("n"), files)
    (rows.join(F.broadcast(lists.select("list_no", "files")), "list_no")
     .withColumn("file", F.pmod(F.xxhash64("product_id"), F.col("files")))
     .repartition("list_no", "file").drop("file", "files")
     .write.mode("errorifexists").partitionBy("list_no").parquet(f"{path}/codes"))
    known = {r["list_no"]: r for r in lists.collect()}
    table = [(i, c.tolist(), *((known[i]["low"], known[i]["high"], known[i]["n"]) if i in known else (0.0, 0.0, 0)))
             for i, c in enumerate(centres)]
    spark.createDataFrame(table, "list_no int, centre array<double>, low double, high double, n long").coalesce(1).write.parquet(
        f"{path}/lists")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> CodedLists:
    """Open stored lists; the driver holds one row per list."""
    rows = spark.read.parquet(f"{path}/lists").orderBy("list_no").collect()
    return CodedLists(spark.read.schema(CODES_DDL).parquet(f"{path}/codes"), np.array([r["centre"] for r in rows]),
                      *(np.array([r[c] for r in rows], dtype=float) for c in ("low", "high", "n")))


class _Hits:
    """Rows that may be among the ``k`` nearest of each query, trimmed as the floors rise."""

    def __init__(self, ids: list, unit: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.unit, self.k = ids, unit.astype(np.float32), k
        self.floor = floor.copy()
        self.best = np.full((len(ids), k), -np.inf)
        self.held: list[list[tuple]] = [[] for _ in ids]

    def add(self, batch, queries: np.ndarray) -> None:
        """Compare a block of codes with some of the queries."""
        width = self.unit.shape[1]
        codes = batch.column("code")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        raw = np.frombuffer(b"".join(codes.to_pylist()), np.int8).reshape(batch.num_rows, width)
        column = {c: batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch.column(c), pa.Array)
                  else batch.column(c).to_numpy() for c in ("step", "slack", "same")}
        dates = batch.column("updated_us").fill_null(NO_DATE).to_pylist()
        names = batch.column("product_id").to_pylist()
        rows = max(1, BLOCK_CELLS // max(1, len(queries)))
        for at in range(0, batch.num_rows, rows):
            part = slice(at, at + rows)
            near = raw[part].astype(np.float32) @ self.unit[queries].T * column["step"][part, None]
            slack = column["slack"][part, None] + MARGIN
            lower = near - slack
            best = np.concatenate([self.best[queries], lower.T], axis=1)
            self.best[queries] = -np.partition(-best, self.k - 1, axis=1)[:, :self.k]
            self.floor[queries] = np.maximum(self.floor[queries], self.best[queries].min(axis=1))
            row, col = np.nonzero(near + slack >= self.floor[queries][None, :])
            for r, c in zip(row.tolist(), col.tolist()):
                self._hold(queries[c], (column["same"][at + r], -dates[at + r], names[at + r], float(lower[r, c]),
                                        float(lower[r, c] + 2 * slack[r, 0])))

    def _hold(self, query: int, row: tuple) -> None:
        held = self.held[query]
        held.append(row)
        if len(held) >= 16 * self.k + 256 and len(held) & (len(held) - 1) == 0:
            self.held[query] = self._trimmed(query)

    def _trimmed(self, query: int) -> list[tuple]:
        """Rows that reach the floor; of equal vectors the ``k`` that come first."""
        kept, seen = [], {}
        for row in sorted((r for r in self.held[query] if r[4] >= self.floor[query]), key=lambda r: (r[1], r[2] or "")):
            seen[row[0]] = seen.get(row[0], 0) + 1
            if seen[row[0]] <= self.k:
                kept.append(row)
        return kept

    def table(self) -> pa.Table:
        rows = [(q, r[2], r[3], r[4]) for n, q in enumerate(self.ids) for r in self._trimmed(n)]
        return pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(
            [("q_id", pa.string()), ("product_id", pa.string()), ("lower", pa.float64()), ("upper", pa.float64())])})


def _queries(table: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
    """Ids, unit vectors and floors of the queries that have a direction."""
    table = table.filter(table.column("q_embedding").is_valid()).combine_chunks()
    if not table.num_rows:
        return [], np.zeros((0, 0)), np.zeros(0)
    column = table.column("q_embedding").combine_chunks()
    unit = _unit_rows(column, len(column[0]))
    known = np.flatnonzero(~np.isnan(unit[:, 0]))
    floor = table.column("floor").to_numpy() if "floor" in table.column_names else np.full(table.num_rows, -1.0)
    return table.column("q_id").take(pa.array(known)).to_pylist(), unit[known], floor[known]


def _chosen(lists: CodedLists, unit: np.ndarray, floor: np.ndarray, k: int, start: bool) -> np.ndarray:
    return lists.first(unit, k) if start else lists.visited(unit, floor)


def _scan_local(lists: CodedLists, table: pa.Table, k: int, start: bool) -> DataFrame:
    """Codes of the lists that any query visits; the batch is sent to every task."""
    spark = lists.codes.sparkSession
    ids, unit, floor = _queries(table)
    chosen = _chosen(lists, unit, floor, k, start) if ids else np.zeros((0, len(lists.count)), dtype=bool)
    shipped = spark.sparkContext.broadcast((ids, unit, floor, chosen))
    asked = np.flatnonzero(chosen.any(axis=0)).tolist()

    def run(batches):
        ids, unit, floor, chosen = shipped.value
        hits = _Hits(ids, unit, floor, k)
        for batch in batches:
            numbers = batch.column("list_no").to_numpy(zero_copy_only=False)
            for no in np.unique(numbers):
                queries = np.flatnonzero(chosen[:, no])
                if len(queries):
                    hits.add(batch.take(pa.array(np.flatnonzero(numbers == no))), queries)
        yield from hits.table().to_batches()

    return lists.codes.filter(F.col("list_no").isin(asked)).mapInArrow(run, HITS_DDL)


def _scan_grid(lists: CodedLists, asked: DataFrame, k: int, start: bool) -> DataFrame:
    """The same for any number of queries: blocks of them meet bounded cells of the lists they visit."""
    spark = asked.sparkSession
    shipped = spark.sparkContext.broadcast((lists.centres, lists.low, lists.high, lists.count))

    def choose(batches):
        own = CodedLists(None, *shipped.value)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ids, unit, floor = _queries(table)
            if not ids:
                continue
            row, no = np.nonzero(_chosen(own, unit, floor, k, start))
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[r] for r in row], pa.string()), pa.array(no.astype("int32"))], names=["q_id", "list_no"])

    def number(key, n):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    floor = F.col("floor") if "floor" in asked.columns else F.lit(-1.0).alias("floor")
    asked = asked.select("q_id", "q_embedding", floor)
    pairs = asked.join(asked.mapInArrow(choose, "q_id string, list_no int"), "q_id")
    blocks = max(1, math.ceil(asked.count() / MAX_QUERY_BLOCK))
    cells = max(1, math.ceil(lists.count.max(initial=0) / CELL_VECTORS))
    left = lists.codes.withColumn("cell", number("product_id", cells)).withColumn("block", every(blocks))
    right = pairs.withColumn("block", number("q_id", blocks)).withColumn("cell", every(cells))

    def meet(codes: pa.Table, queries: pa.Table) -> pa.Table:
        ids, unit, floor = _queries(queries)
        hits = _Hits(ids, unit, floor, k)
        if ids and codes.num_rows:
            hits.add(codes, np.arange(len(ids)))
        return hits.table()

    keys = ["list_no", "block", "cell"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, HITS_DDL)


def _scan(lists: CodedLists, asked: DataFrame, k: int, start: bool) -> DataFrame:
    table = local_table(asked, MAX_QUERY_BLOCK)
    return _scan_grid(lists, asked, k, start) if table is None else _scan_local(lists, table, k, start)


def _floors(hits: DataFrame, k: int) -> DataFrame:
    """(q_id, floor): the k-th best lower end of each query that has so many."""
    best = top_k(hits, ["q_id"], [F.col("lower").desc(), F.col("product_id")], k, ["product_id"])
    return best.filter(F.col("rank") == k).select("q_id", F.col("lower").alias("floor"))


def search(asked: DataFrame, lists: CodedLists, vectors: DataFrame, k: int) -> DataFrame:
    """(q_id, rank, product_id, similarity, compared): the ``k`` nearest vectors of each query.

    ``asked`` has q_id, q_embedding; ``vectors`` are the product_id, embedding,
    updated_at that the lists were made from. The nearest lists that hold ``k``
    vectors give a first floor; then every list that the bounds leave is read,
    and rows that reach the floor are compared as full vectors, ``compared`` for
    each query. Ties go by date and id. Queries without a direction have no rows.
    """
    asked = stored(asked.select("q_id", "q_embedding"), "asked")
    floors = _floors(_scan(lists, asked, k, True), k)
    asked = stored(asked.join(floors, "q_id", "left").select(
        "q_id", "q_embedding", F.coalesce("floor", F.lit(-1.0)).alias("floor")), "floors")
    hits = stored(_scan(lists, asked, k, False), "hits")
    hits = hits.join(_floors(hits, k).withColumnRenamed("floor", "least"), "q_id", "left").filter(
        F.col("least").isNull() | (F.col("upper") >= F.col("least"))).select("q_id", "product_id")
    full = hits.join(vectors.select("product_id", "embedding", "updated_at"), "product_id").join(
        asked.select("q_id", "q_embedding"), "q_id")
    compared = hits.groupBy("q_id").agg(F.count("*").alias("compared"))
    rows = full.select("q_id", "product_id", "updated_at", ladders.rounded(
        cosine_similarity(F.col("q_embedding"), F.col("embedding"))).alias("similarity"))
    order = [F.col("similarity").desc(), F.col("updated_at").desc_nulls_last(), F.col("product_id").asc()]
    return top_k(rows, ["q_id"], order, k, ["product_id"]).join(compared, "q_id").select(
        "q_id", "rank", "product_id", "similarity", "compared")
