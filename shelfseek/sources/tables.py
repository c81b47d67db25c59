"""Readers and writers of the catalogue and of the search tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfseek import schema
from shelfseek.session import shared_dir


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A catalogue table stored as parquet, with its declared layout."""
    return spark.read.schema(schema.struct_type(name)).parquet(path)


def read_jdbc(spark: SparkSession, url: str, name: str, user: str, password: str,
              partition_column: str | None = None, lower: str | None = None,
              upper: str | None = None, partitions: int = 32) -> DataFrame:
    """A catalogue table from a database, in parallel ranges of a numeric or time column."""
    reader = spark.read.format("jdbc").options(
        url=url, dbtable=name, user=user, password=password, fetchsize=10_000)
    if partition_column:
        reader = reader.options(partitionColumn=partition_column, lowerBound=lower,
                                upperBound=upper, numPartitions=partitions)
    return reader.load()


def write_sorted(df: DataFrame, path: str, *keys: str) -> None:
    """Range-partitioned and sorted files, so that a filter on the first key skips most.

    Further keys split a first key that holds many rows over several files.
    """
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("errorifexists").parquet(path)


def write_bucketed(df: DataFrame, table: str, path: str, key: str, buckets: int,
                   *order: str) -> DataFrame:
    """A table with one file per bucket of ``key``, sorted by ``order`` inside.

    Equally bucketed tables join and group on ``key`` without a shuffle, and
    the order lets a filter on its first column skip parts of every file.
    """
    (df.repartition(buckets, key).write.mode("errorifexists").option("path", path)
     .bucketBy(buckets, key).sortBy(*(order or (key,))).saveAsTable(table))
    return df.sparkSession.table(table)


def open_bucketed(spark: SparkSession, table: str, path: str, key: str, buckets: int,
                  *order: str) -> DataFrame:
    """A table written by ``write_bucketed``, entered in this session's catalogue with its layout.

    A name stands for one path; opening another under it fails.
    """
    if spark.catalog.tableExists(table):
        at = spark.sql(f"DESCRIBE FORMATTED {table}").filter("col_name = 'Location'").first()["data_type"]
        if at.split(":", 1)[-1].rstrip("/").lstrip("/") != path.split(":", 1)[-1].rstrip("/").lstrip("/"):
            raise ValueError(f"{table} is the table at {at}, not at {path}")
        return spark.table(table)
    layout = spark.read.parquet(path).schema
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in layout)
    spark.sql(f"CREATE TABLE {table} ({columns}) USING parquet "
              f"CLUSTERED BY ({key}) SORTED BY ({', '.join(order or (key,))}) INTO {buckets} BUCKETS "
              f"LOCATION '{path}'")
    return spark.table(table)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a fresh folder of the shared working place and read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``stored``, bucketed on ``key``: joins on it leave these rows where they are."""
    spark = df.sparkSession
    table = f"{name}-{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return write_bucketed(df, table.replace("-", "_"), f"{shared_dir(spark)}/{table}", key, buckets)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a query begun inside has shuffled goes when it ends, not when the driver collects its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
