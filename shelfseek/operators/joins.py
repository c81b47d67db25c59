"""Joins and top-k that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

MAX_LOCAL_ROWS = 20_000
MAX_ROW_CHARS = 16_000
SALTS = 32
#: Rows of one key that a task may take; keys with more are measured and cut into parts.
HEAVY_ROWS = 1_000_000
#: Bins that keys are counted in before they are counted themselves.
KEY_BINS = 1 << 14


def local_table(df: DataFrame, max_rows: int = MAX_LOCAL_ROWS,
                max_chars: int = MAX_ROW_CHARS) -> pa.Table | None:
    """All rows of a frame if they are few and short, else None.

    At most ``max_rows + 1`` rows are fetched, and the contents of longer
    rows stay behind, so the driver's share is bounded whatever the frame is.
    """
    short = F.length(F.to_json(F.struct(*df.columns))) <= max_chars
    rows = df.limit(max_rows + 1).select(
        short.alias("_short"), *[F.when(short, F.col(c)).alias(c) for c in df.columns]).toArrow()
    if rows.num_rows > max_rows or not pc.all(rows["_short"], min_count=0).as_py():
        return None
    return rows.drop_columns("_short")


def localize(df: DataFrame, max_rows: int = MAX_LOCAL_ROWS,
             max_chars: int = MAX_ROW_CHARS) -> DataFrame | None:
    """A proven-small frame computed once and held as a local relation, else None."""
    table = local_table(df, max_rows, max_chars)
    return None if table is None else df.sparkSession.createDataFrame(table, schema=df.schema)


def are_small(*frames: DataFrame, max_rows: int = MAX_LOCAL_ROWS,
              max_chars: int = MAX_ROW_CHARS) -> list[bool]:
    """Measure at most ``max_rows + 1`` rows of each frame to prove that it may be broadcast."""
    parts = [frame.limit(max_rows + 1).agg(
        F.lit(i).alias("i"), F.count("*").alias("n"),
        F.max(F.length(F.to_json(F.struct(*frame.columns)))).alias("longest"))
        for i, frame in enumerate(frames)]
    seen = reduce(DataFrame.unionByName, parts).collect()
    fits = {r["i"]: r["n"] <= max_rows and (r["longest"] or 0) <= max_chars for r in seen}
    return [fits[i] for i in range(len(frames))]


def salted_join(big: DataFrame, other: DataFrame, on: Sequence[str], how: str,
                spread: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Shuffle join that cuts each key of ``big`` into ``salts`` parts by a row hash.

    ``other`` is repeated once per part, so every row of ``big`` meets every
    match exactly once.
    """
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    right = other.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def heavy_keys(big: DataFrame, on: Sequence[str]) -> DataFrame:
    """The keys without NULL that more than ``HEAVY_ROWS`` rows of ``big`` have.

    Bins of keys are counted first, each task adding up its own, so keys that are all different do not move. A
    heavy key makes its bin a heavy one; keys are counted themselves in such bins alone.
    """
    bins = big.dropna(subset=list(on)).withColumn("_bin", F.pmod(F.xxhash64(*on), F.lit(KEY_BINS)).cast("int"))
    full = [r[0] for r in bins.groupBy("_bin").agg(F.count("*").alias("_rows"))
            .filter(F.col("_rows") > HEAVY_ROWS).select("_bin").collect()]
    rows = bins.filter(F.col("_bin").isin(full)) if full else bins.limit(0)
    return rows.groupBy(*on).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > HEAVY_ROWS).drop("_rows")


def split_join(big: DataFrame, other: DataFrame, on: Sequence[str], how: str,
               spread: Sequence[str], salts: int = SALTS) -> DataFrame:
    """Shuffle join that cuts only the keys with more than ``HEAVY_ROWS`` rows of ``big``.

    Heavy keys are counted first. Without any the join is plain; with more than may be broadcast all keys are salted.
    """
    heavy = localize(heavy_keys(big, on))
    if heavy is None:
        return salted_join(big, other, on, how, spread, salts)
    if heavy.isEmpty():
        return big.join(other, list(on), how)
    heavy = F.broadcast(heavy.withColumn("_heavy", F.lit(True)))
    part = F.when(F.col("_heavy"), F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).otherwise(0)
    parts = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = big.join(heavy, list(on), "left").withColumn("_salt", part).drop("_heavy")
    right = other.join(heavy, list(on), "left").withColumn("_salt", F.explode(parts)).drop("_heavy")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def lookup_join(big: DataFrame, other: DataFrame, on: Sequence[str], how: str = "inner",
                spread: Sequence[str] = (), small: bool | None = None) -> DataFrame:
    """Join to a side that is usually small: broadcast if proven so, salted otherwise."""
    if are_small(other)[0] if small is None else small:
        return big.join(F.broadcast(other), list(on), how)
    return salted_join(big, other, on, how, spread or big.columns)


def rank_parts(df: DataFrame) -> int:
    """How many parts a group is ranked in before the parts are ranked together."""
    return max(SALTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
          spread: Sequence[str], rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group, ranked from 1.

    Groups are first ranked in parts, then across parts: what the tasks of a
    large scan have left of one group never meets in one task.
    """
    part = F.pmod(F.xxhash64(*spread), F.lit(rank_parts(df)))
    inner = Window.partitionBy(*keys, part).orderBy(*order)
    df = df.withColumn(rank, F.row_number().over(inner)).filter(F.col(rank) <= k).drop(rank)
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= k)
