"""Image files as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

# Fixed value: largest upload, 10 MB.
MAX_IMAGE_BYTES = 10 * 1024 * 1024


def read_images(spark: SparkSession, path: str, max_bytes: int = MAX_IMAGE_BYTES,
                pattern: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(path, length, content) of files that fit, and (path, length, error) of those that do not.

    The size filter reaches the file source, so large files are not loaded.
    Files without any content are not listed by the source.
    """
    reader = spark.read.format("binaryFile")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path)
    fits = files.filter(F.col("length") <= max_bytes).select("path", "length", "content")
    large = files.filter(F.col("length") > max_bytes).select(
        "path", "length", F.lit("file is too large").alias("error"))
    return fits, large
