"""Embedding jobs: pending selection, encoding in workers, outcomes and retry classes."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from shelfseek.session import ship_package

# HTTP answers worth another try, model name, vector width, request headers.
RETRYABLE_STATUS = [408, 420, 425, 429, 500, 502, 503, 504]
MODEL_VERSION = "clip-vit-base-patch32"
VECTOR_WIDTH = 512
FETCH_TIMEOUT_S = 15.0
FETCH_HEADERS = {
    "User-Agent": "Mozilla/5.0 (Macintosh; Intel Mac OS X 10_15_7) AppleWebKit/537.36 "
                  "(KHTML, like Gecko) Chrome/124.0.0.0 Safari/537.36",
    "Accept": "image/avif,image/webp,image/apng,image/*,*/*;q=0.8",
    "Accept-Language": "en-US,en;q=0.9",
}

# Fixed value: the largest picture taken.
MAX_IMAGE_BYTES = 10 << 20
#: Rows encoded at once, and downloads of a task that run side by side.
ENCODE_ROWS, FETCH_THREADS = 64, 16

Encoder = Callable[[list], np.ndarray]
Fetcher = Callable[[str, dict, float], bytes]


class FetchFailed(Exception):
    """A download that failed; ``status`` is the HTTP answer, or None without one."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


@dataclass(frozen=True)
class HashEncoder:
    """Stand-in encoder for tests: hashed word or byte-pair counts. Same input, same vector."""
    width: int = VECTOR_WIDTH

    def __call__(self, items: list) -> np.ndarray:
        out = np.zeros((len(items), self.width))
        for row, item in enumerate(items):
            if isinstance(item, str):
                for word in item.lower().split():
                    code = zlib.crc32(word.encode())
                    out[row, code % self.width] += 1 if code >> 31 else -1
            else:
                data = np.frombuffer(item, dtype=np.uint8).astype(np.int64)
                out[row] = np.bincount((data[:-1] * 257 + data[1:]) % self.width,
                                       minlength=self.width)
        return out


def pending(products: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Products with a picture and no embedding."""
    return (products.filter(F.col("image_url").isNotNull() & (F.col("image_url") != ""))
            .join(embeddings.select(F.col("product_id").alias("id")), "id", "left_anti"))


def newest(products: DataFrame, n: int) -> DataFrame:
    return products.orderBy(F.col("updated_at").desc_nulls_last(),
                            F.col("created_at").desc_nulls_last(), F.col("id")).limit(n)


def pending_retry(products: DataFrame, embeddings: DataFrame, status: DataFrame, now,
                  limit: int | None = None) -> DataFrame:
    """Ids without embedding that were never tried, or wait for a retry that is due.

    Of several attempts at a product the latest counts. The first ``limit`` ids, or all.
    """
    latest = status.groupBy("product_id").agg(F.max_by(
        F.struct(F.col("id").alias("status_id"), "status", "next_retry_at"),
        F.struct("attempted_at", "id")).alias("s"))
    tried = latest.select(F.col("product_id").alias("id"), "s.*")
    due = (products.filter(F.col("image_url").isNotNull()).select("id")
            .join(embeddings.select(F.col("product_id").alias("id")), "id", "left_anti")
            .join(tried, "id", "left")
            .filter(F.col("status_id").isNull() | F.col("status").isin("PENDING", "RETRY"))
            .filter(F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
            .select("id"))
    return due if limit is None else due.orderBy("id").limit(limit)


def is_retryable(status: Column) -> Column:
    return status.isNull() | status.isin(RETRYABLE_STATUS)


def _encode_all(items: Sequence, encode: Encoder) -> tuple[list, list]:
    """Unit vectors and errors; one bad item does not spoil its batch."""
    items = list(items)
    if not items:
        return [], []
    try:
        vectors = np.asarray(encode(items), dtype=np.float64)
        failures = [None] * len(items)
    except Exception as error:  # noqa: BLE001 - reported per row
        if len(items) == 1:
            return [None], [str(error) or type(error).__name__]
        parts = [_encode_all([item], encode) for item in items]
        return [p[0][0] for p in parts], [p[1][0] for p in parts]
    length = np.linalg.norm(vectors, axis=1)
    out = []
    for row, size in enumerate(length):
        if np.isfinite(size) and size > 0:
            out.append((vectors[row] / size).astype(np.float32))
        else:
            out.append(None)
            failures[row] = "encoder gave a vector without length"
    return out, failures


def _embed(df: DataFrame, column: str, make_encoder: Callable[[], Encoder],
           refuse: Callable[[object], str | None]) -> DataFrame:
    ship_package(df.sparkSession)
    schema = df.schema.simpleString()[len("struct<"):-1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()
        for frame in _slices(frames):
            errors = [refuse(v) for v in frame[column]]
            good = [i for i, e in enumerate(errors) if e is None]
            vectors: list = [None] * len(frame)
            done, failed = _encode_all([frame[column].iloc[i] for i in good], encode)
            for i, vector, failure in zip(good, done, failed):
                vectors[i], errors[i] = vector, failure
            yield frame.assign(embedding=vectors, error=errors)

    return df.mapInPandas(run, f"{schema},embedding:array<float>,error:string")


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for start in range(0, len(frame), ENCODE_ROWS):
            yield frame.iloc[start:start + ENCODE_ROWS].reset_index(drop=True)


def embed_texts(df: DataFrame, make_encoder: Callable[[], Encoder], column: str = "text"
                ) -> DataFrame:
    """``df`` with ``embedding`` and ``error``; blank text is an error."""
    return _embed(df, column, make_encoder,
                  lambda v: None if v and v.strip() else "no text to embed")


def embed_images(df: DataFrame, make_encoder: Callable[[], Encoder], column: str = "content"
                 ) -> DataFrame:
    return _embed(df, column, make_encoder, lambda v: None if v else "image is empty")


def embed_urls(df: DataFrame, fetch: Fetcher, make_encoder: Callable[[], Encoder],
               column: str = "image_url", headers: dict | None = None,
               timeout: float = FETCH_TIMEOUT_S) -> DataFrame:
    """Download and encode in the workers; adds embedding, error, http_status, retryable.

    A task holds the pictures of ``ENCODE_ROWS`` rows at a time, none of them
    larger than ``MAX_IMAGE_BYTES``.
    """
    sent = FETCH_HEADERS if headers is None else headers
    ship_package(df.sparkSession)
    schema = df.schema.simpleString()[len("struct<"):-1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(url):
            try:
                body = fetch(url, {**sent, "Referer": url}, timeout)
            except FetchFailed as failure:
                return None, str(failure), failure.status
            except Exception as failure:  # noqa: BLE001 - reported per row
                return None, str(failure) or type(failure).__name__, None
            if len(body) > MAX_IMAGE_BYTES:
                return None, f"image is larger than {MAX_IMAGE_BYTES} bytes", 413
            return body, None, None

        encode = make_encoder()
        for frame in _slices(frames):
            with ThreadPoolExecutor(FETCH_THREADS) as pool:
                got = list(pool.map(one, frame[column]))
            bodies = {i: body for i, (body, _, _) in enumerate(got) if body is not None}
            vectors, errors, codes = [None] * len(got), [e for _, e, _ in got], [c for *_, c in got]
            done, failed = _encode_all(list(bodies.values()), encode)
            for i, vector, failure in zip(bodies, done, failed):
                vectors[i], errors[i] = vector, failure
                codes[i] = 400 if failure else None
            yield frame.assign(embedding=vectors, error=errors,
                               http_status=pd.array(codes, dtype="Int32"))

    out = df.mapInPandas(run, f"{schema},embedding:array<float>,error:string,http_status:int")
    return out.withColumn("retryable", F.when(F.col("error").isNotNull(),
                                              is_retryable(F.col("http_status"))))


def classify(ids: DataFrame, products: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(product_id, image_url, status, reason) before any download.

    ``failed`` for unknown products, ``skipped`` without picture or with an
    embedding, ``pending`` for the rest.
    """
    known = products.select(F.col("id").alias("product_id"), "image_url",
                            F.lit(True).alias("known"))
    stored = embeddings.select("product_id", F.lit(True).alias("stored")).distinct()
    rows = (ids.select("product_id").distinct().join(known, "product_id", "left")
            .join(stored, "product_id", "left"))
    no_picture = F.col("image_url").isNull() | F.col("image_url").rlike(r"^\s*$")
    reason = (F.when(F.col("known").isNull(), "product not found")
              .when(no_picture, "no image")
              .when(F.col("stored"), "already embedded"))
    return rows.select(
        "product_id", "image_url",
        F.when(F.col("known").isNull(), "failed").when(reason.isNotNull(), "skipped")
        .otherwise("pending").alias("status"), reason.alias("reason"))


def index_products(ids: DataFrame, products: DataFrame, embeddings: DataFrame, fetch: Fetcher,
                   make_encoder: Callable[[], Encoder]) -> DataFrame:
    """One outcome per id, with the new vector where one was made.

    The result is read more than once by its users; write it before splitting
    it into new embeddings, errors and counts.
    """
    rows = classify(ids, products, embeddings)
    waiting = rows.filter("status = 'pending'").select("product_id", "image_url")
    # Rows are tiny and their work is not, so tasks are not merged by bytes.
    tasks = int(waiting.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tried = embed_urls(waiting.repartition(tasks, "product_id"), fetch, make_encoder)
    done = tried.select(
        "product_id", "image_url",
        F.when(F.col("error").isNull(), "indexed").otherwise("failed").alias("status"),
        F.col("error").alias("reason"), "http_status", "retryable", "embedding")
    return done.unionByName(rows.filter("status <> 'pending'"), allowMissingColumns=True)


def new_embeddings(outcomes: DataFrame, now, model_version: str = MODEL_VERSION,
                   make_id=None) -> DataFrame:
    """Rows to append to the embeddings table."""
    return outcomes.filter("status = 'indexed'").select(
        (F.expr("uuid()") if make_id is None else make_id).alias("id"), "product_id", "embedding",
        F.col("image_url").alias("source_image_url"), F.lit(model_version).alias("model_version"),
        now.alias("created_at"))


def retry_rows(outcomes: DataFrame, next_retry_at, now) -> DataFrame:
    """Failed downloads as status rows, which ``pending_retry`` reads."""
    return outcomes.filter("status = 'failed' and embedding is null and reason <> 'product not found'"
                           ).select(
        F.col("product_id").alias("id"), "product_id",
        F.when(F.col("retryable"), "RETRY").otherwise("FAILED").alias("status"),
        F.when(F.col("retryable"), next_retry_at).alias("next_retry_at"), now.alias("attempted_at"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("status").agg(F.count("*").alias("n"))
