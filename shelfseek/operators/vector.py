"""Vector ranking: blocks of vectors times the query matrix, best rows kept per task."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from shelfseek.functions import ladders
from shelfseek.operators.filters import FILTERS, QueryBatch, filtered_terms
from shelfseek.operators.joins import local_table, lookup_join, rank_parts, top_k
from shelfseek.session import ship_package

# Similarity threshold and page sizes of a similarity search.
SIMILARITY_THRESHOLD = 0.5
DEFAULT_PER_PAGE, MAX_PER_PAGE = 50, 200

MAX_QUERY_BLOCK = 4096
CELL_VECTORS = 20_000
MAX_BLOCK_CELLS = 4_000_000
MAX_HELD_ROWS = 400_000
FOUND_DDL = "q_id string, product_id string, similarity double, updated_us long, hits long"
FILTERED_COLUMNS = ["category_keys", "company_lower", "sortable_price"]
NO_DATE = np.iinfo(np.int64).min


@dataclass
class Probes:
    """The query side of a scan: unit vectors, how many rows each wants, what it may see."""
    ids: list[str]
    matrix: np.ndarray
    depth: np.ndarray
    threshold: np.ndarray
    filters: list[tuple]
    filter_no: np.ndarray
    lists: dict[int, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def of(table: pa.Table) -> Probes:
        """From q_id, q_embedding, depth, threshold and filters; a zero vector probes nothing."""
        none = [None] * table.num_rows
        filters = list(zip(*(table.column(c).to_pylist() if c in table.column_names else none
                             for c in FILTERS)))
        rows = [(q, np.asarray(v, dtype=np.float64), k, t, f) for q, v, k, t, f in zip(
            *(table.column(c).to_pylist() for c in ("q_id", "q_embedding", "depth", "threshold")),
            filters) if v is not None]
        rows = [r for r in rows if np.isfinite(r[1]).all() and np.linalg.norm(r[1]) > 0]
        widths = {len(r[1]) for r in rows}
        if len(widths) > 1:
            raise ValueError(f"query vectors of different widths: {sorted(widths)}")
        matrix = np.array([r[1] / np.linalg.norm(r[1]) for r in rows])
        distinct = sorted({r[4] for r in rows}, key=repr)
        return Probes(
            [r[0] for r in rows], matrix, np.array([r[2] for r in rows], dtype=np.int64),
            np.array([-np.inf if r[3] is None else r[3] for r in rows]),
            distinct,
            np.array([distinct.index(r[4]) for r in rows], dtype=np.int64))


def _unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Rows scaled to length 1; rows without a direction become NaN."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != width).any():
        bad = sizes[sizes != width][0]
        raise ValueError(f"vector width {bad} does not fit query width {width}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(sizes), width)
    length = np.linalg.norm(rows, axis=1)
    length[~(length > 0) | ~np.isfinite(length)] = np.nan
    return rows / length[:, None]


class _Best:
    """Best rows per query seen so far, cut back whenever too many are held."""

    def __init__(self, probes: Probes):
        self.probes = probes
        self.bound = np.full(len(probes.ids), -np.inf)
        self.counts = np.zeros(len(probes.ids), dtype=np.int64)
        self.held: list[pd.DataFrame] = []
        self.size = 0

    def add(self, queries: np.ndarray, similarity: np.ndarray, ids: np.ndarray,
            dates: np.ndarray) -> None:
        """Take a block: ``similarity`` is rows x queries, NaN where not to be seen."""
        with np.errstate(invalid="ignore"):
            hit = similarity >= self.probes.threshold[queries][None, :]
        self.counts[queries] += hit.sum(axis=0)
        value = np.where(hit, similarity, -np.inf)
        deepest = int(self.probes.depth[queries].max(initial=1))
        floor = self.bound[queries]
        if len(value) > deepest:
            floor = np.maximum(floor, -np.partition(-value, deepest - 1, axis=0)[deepest - 1])
        row, col = np.nonzero(hit & (value >= floor[None, :]))
        if len(row):
            self.held.append(pd.DataFrame({"q": queries[col], "similarity": value[row, col],
                                           "date": dates[row], "id": ids[row]}))
            self.size += len(row)
            if self.size > MAX_HELD_ROWS:
                self.cut()

    def cut(self) -> pd.DataFrame:
        if not self.held:
            return pd.DataFrame({"q": [], "similarity": [], "date": [], "id": []})
        rows = pd.concat(self.held, ignore_index=True).sort_values(
            ["q", "similarity", "date", "id"], ascending=[True, False, False, True])
        place = rows.groupby("q").cumcount().to_numpy()
        depth = self.probes.depth[rows["q"].to_numpy()]
        last = rows[place == depth - 1]
        self.bound[last["q"].to_numpy()] = last["similarity"].to_numpy()
        rows = rows[place < depth]
        self.held, self.size = [rows], len(rows)
        return rows

    def table(self) -> pa.Table:
        """Kept rows, then one row per query with the number of rows over its threshold."""
        rows = self.cut()
        names = np.array(self.probes.ids, dtype=object)
        seen = np.flatnonzero(self.counts)
        n = len(rows)
        kept = np.arange(n + len(seen)) < n
        q = np.concatenate([rows["q"].to_numpy(dtype=np.int64), seen])
        return pa.table({
            "q_id": pa.array(names[q], pa.string()),
            "product_id": pa.array(list(rows["id"]) + [None] * len(seen), pa.string()),
            "similarity": pa.array(np.concatenate(
                [rows["similarity"].to_numpy(dtype=float), np.zeros(len(seen))]), mask=~kept),
            "updated_us": pa.array(np.concatenate(
                [rows["date"].to_numpy(dtype=np.int64), np.zeros(len(seen), dtype=np.int64)]),
                mask=~kept),
            "hits": pa.array(np.concatenate([np.zeros(n, dtype=np.int64), self.counts[seen]])),
        })


def _blocks(batch: pa.RecordBatch | pa.Table, probes: Probes
            ) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, query numbers) to multiply: all with all, or by list."""
    everything = np.arange(len(probes.ids))
    if not probes.lists:
        parts = [(np.arange(batch.num_rows), everything)]
    else:
        list_no = np.asarray(batch.column("list_no"))
        parts = [(np.flatnonzero(list_no == no), probes.lists[no])
                 for no in np.unique(list_no) if no in probes.lists]
    for rows, queries in parts:
        step = max(1, MAX_BLOCK_CELLS // max(1, len(queries)))
        for at in range(0, len(rows), step):
            yield rows[at:at + step], queries


def scan_batches(batches: Iterable[pa.RecordBatch], probes: Probes) -> _Best:
    """Best rows of one task. Similarity is rounded so that copies tie in any block."""
    best = _Best(probes)
    if not probes.ids:
        return best
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column("embedding")
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        unit = _unit_rows(column, probes.matrix.shape[1])
        ids = np.array(batch.column("product_id").to_pylist(), dtype=object)
        dates = batch.column("updated_us").fill_null(NO_DATE).to_numpy(zero_copy_only=False)
        allowed = _allowed(batch, probes)
        for rows, queries in _blocks(batch, probes):
            similarity = np.round(np.clip(unit[rows] @ probes.matrix[queries].T, -1, 1),
                                  ladders.SCORE_DECIMALS)
            if allowed is not None:
                similarity = np.where(allowed[rows][:, probes.filter_no[queries]],
                                      similarity, np.nan)
            best.add(queries, similarity, ids[rows], dates[rows])
    return best


def _allowed(batch: pa.RecordBatch | pa.Table, probes: Probes) -> np.ndarray | None:
    """Rows x filters: which rows each distinct filter lets through."""
    if not any(v is not None for f in probes.filters for v in f):
        return None
    rows = batch.num_rows

    def whole(name):
        column = batch.column(name)
        return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column

    def equal(values, wanted):
        return pc.fill_null(pc.equal(values, wanted), False).to_numpy(zero_copy_only=False)

    keys = whole("category_keys").flatten()
    price = whole("sortable_price").to_numpy(zero_copy_only=False).astype(float)
    allowed = np.ones((rows, len(probes.filters)), dtype=bool)
    for no, (category, shop, low, high) in enumerate(probes.filters):
        if category is not None:
            allowed[:, no] &= equal(keys, category).reshape(rows, -1).any(axis=1)
        if shop is not None:
            allowed[:, no] &= equal(whole("company_lower"), shop)
        # A missing price is NaN here and fails both bounds.
        if low is not None:
            allowed[:, no] &= price >= low
        if high is not None:
            allowed[:, no] &= price <= high
    return allowed


def _prepared(vectors: DataFrame) -> DataFrame:
    at = (F.unix_micros("updated_at") if "updated_at" in vectors.columns
          else F.lit(None).cast("long"))
    extra = [c for c in ("category_keys", "company_lower", "list_no") if c in vectors.columns]
    if "sortable_price" in vectors.columns:
        extra.append(F.col("sortable_price").cast("double"))
    return vectors.select("product_id", "embedding", at.alias("updated_us"), *extra)


def scan(vectors: DataFrame, queries: DataFrame | pa.Table,
         lists: DataFrame | None = None) -> DataFrame:
    """Best rows and hit counts per query and task.

    ``queries`` has q_id, q_embedding, depth, threshold and maybe filters. A batch
    that fits one block is sent to every task; a larger one is cut into blocks
    that meet cells of vectors on a grid. A table is a batch known to fit.
    With ``lists`` (q_id, list_no) a query meets only the vectors of its lists.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    prepared = _prepared(vectors)
    local = queries if isinstance(queries, pa.Table) else local_table(queries, MAX_QUERY_BLOCK)
    if local is None:
        return _scan_grid(prepared, queries, lists)
    probes = Probes.of(local)
    if lists is not None:
        asked: dict[int, list[int]] = {}
        numbers = {q_id: number for number, q_id in enumerate(probes.ids)}
        # The lists of one block of queries.
        for row in lists.collect():
            if row["q_id"] in numbers:
                asked.setdefault(row["list_no"], []).append(numbers[row["q_id"]])
        probes.lists = {no: np.array(numbers) for no, numbers in asked.items()}
        prepared = prepared.filter(F.col("list_no").isin(sorted(asked)))
    shipped = spark.sparkContext.broadcast(probes)

    def run(batches):
        yield from scan_batches(batches, shipped.value).table().to_batches()

    return prepared.mapInArrow(run, FOUND_DDL)


def _scan_grid(vectors: DataFrame, queries: DataFrame, lists: DataFrame | None = None
               ) -> DataFrame:
    """Every query block meets every cell of vectors once, each meeting in its own group.

    With ``lists`` there is a grid in every list.
    """
    keys = ["block", "cell"]
    blocks = max(1, math.ceil(queries.count() / MAX_QUERY_BLOCK))
    if lists is None:
        cells = max(1, math.ceil(vectors.count() / CELL_VECTORS))
    else:
        keys = ["list_no", *keys]
        largest = vectors.groupBy("list_no").count().agg(F.max("count")).first()[0] or 0
        cells = max(1, math.ceil(largest / CELL_VECTORS))
        queries = queries.join(lists, "q_id")

    def number(key, n):
        return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = vectors.withColumn("cell", number("product_id", cells)).withColumn(
        "block", every(blocks))
    right = queries.withColumn("block", number("q_id", blocks)).withColumn("cell", every(cells))

    def meet(vector_rows: pa.Table, query_rows: pa.Table) -> pa.Table:
        return scan_batches([vector_rows], Probes.of(query_rows)).table()

    return (left.groupBy(*keys).cogroup(right.groupBy(*keys))
            .applyInArrow(meet, FOUND_DDL))


def nearest_order():
    return [F.col("similarity").desc_nulls_last(), F.col("updated_us").desc_nulls_last(),
            F.col("product_id").asc_nulls_last()]


def ranked_hits(found: DataFrame, max_depth: int) -> DataFrame:
    """(q_id, product_id, similarity, rank, total) merged over tasks, in two steps.

    A query's rows from all tasks are first trimmed in parts. Counts ride along:
    the first row of each part carries the part's count.
    """
    parted = found.withColumn("part", F.pmod(F.xxhash64("product_id"), F.lit(rank_parts(found))))
    within = Window.partitionBy("q_id", "part")
    trimmed = (parted.withColumn("rn", F.row_number().over(within.orderBy(*nearest_order())))
               .withColumn("hits", F.sum("hits").over(within))
               .filter(F.col("rn") <= max_depth)
               .withColumn("hits", F.when(F.col("rn") == 1, F.col("hits")).otherwise(0)))
    whole = Window.partitionBy("q_id")
    return (trimmed.withColumn("rank", F.row_number().over(whole.orderBy(*nearest_order())))
            .withColumn("total", F.sum("hits").over(whole))
            .filter(F.col("product_id").isNotNull())
            .select("q_id", "product_id", "similarity", "rank", "total"))


def semantic_candidates(batch: QueryBatch, docs: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(q_id, product_id, score): nearest filtered documents, score floored at 0.

    Queries without an embedding have no semantic candidates.
    """
    columns = [] if batch.one_filter else FILTERED_COLUMNS
    seen = filtered_terms(docs, batch).select("product_id", "updated_at", *columns)
    vectors = embeddings.select("product_id", "embedding").join(seen, "product_id")
    names = ["q_id", "q_embedding", "vector_depth", *([] if batch.one_filter else FILTERS)]
    if batch.small and batch.table.num_rows <= MAX_QUERY_BLOCK:
        asked = batch.table.select(names).rename_columns(
            ["depth" if n == "vector_depth" else n for n in names]).append_column(
            "threshold", pa.nulls(batch.table.num_rows, pa.float64()))
    else:
        asked = batch.frame.filter("q_embedding is not null").select(*names).withColumnRenamed(
            "vector_depth", "depth").withColumn("threshold", F.lit(None).cast("double"))
    found = scan(vectors, asked).filter(F.col("product_id").isNotNull())
    best = top_k(found, ["q_id"], nearest_order(), batch.max_vector_depth, ["product_id"])
    depths = batch.frame.select("q_id", "vector_depth")
    return (lookup_join(best, depths, ["q_id"], "inner", ["product_id"], batch.small)
            .filter(F.col("rank") <= F.col("vector_depth"))
            .select("q_id", "product_id",
                    F.greatest(F.lit(0.0), F.col("similarity")).alias("score")))
