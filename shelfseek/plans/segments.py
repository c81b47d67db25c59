"""A search index kept up by small segments beside a large one.

Every change writes one segment: the search tables of the changed documents and
the ids it drops from earlier segments. A version is a short table that lists
segments by path, the oldest first; nothing that a version lists is ever written
again, so a reader keeps the version it opened. What is read is the union of all
segments, each without the ids that later ones drop. Once the later segments
have dropped a stated share of the first, or are many, all are merged into one.

All segments are bucketed alike on the product id, and dropped ids meet rows by
broadcast if few, by bucket otherwise, so that reading moves no row. Grams, offers and
field values are sorted by what is looked up; of field values only those looked up move.
"""

from __future__ import annotations

import hashlib
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from shelfseek.operators.lexical import postings
from shelfseek.operators.suggest import suggestion_offers
from shelfseek.operators.trigram import trigram_index
from shelfseek.operators.values import field_values
from shelfseek.plans.hybrid import SearchIndex
from shelfseek.sources.tables import open_bucketed, stored, write_bucketed, write_sorted

#: Merge once later segments have dropped this share of the first one's documents, or are so many.
MERGE_SHARE, MAX_SEGMENTS = 0.2, 16
#: Dropped ids of so many bytes may be broadcast.
FEW_ID_BYTES = 4 << 20

VERSION_DDL = "place int, path string, buckets int, documents long, dropped long, id_bytes long, fold_accents boolean"
ORDERS = {"documents": (), "embeddings": (), "postings": ("term", "product_id"), "dropped": ()}


@dataclass
class Segment:
    place: int
    path: str
    buckets: int
    documents: int
    dropped: int
    id_bytes: int
    fold_accents: bool


# ---- versions

def versions(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all versions below ``root``, ascending."""
    rows = spark.read.schema(f"{VERSION_DDL}, version int").parquet(f"{root}/versions")
    return [r[0] for r in rows.select("version").distinct().orderBy("version").collect()]


def segments_of(spark: SparkSession, root: str, version: int | None = None) -> list[Segment]:
    """The segments of a version, the newest if none is named; at most ``MAX_SEGMENTS`` and one."""
    rows = spark.read.schema(f"{VERSION_DDL}, version int").parquet(f"{root}/versions")
    number = rows.agg(F.max("version")).first()[0] if version is None else version
    return [Segment(*r[:7]) for r in rows.filter(F.col("version") == number).orderBy("place").collect()]


def publish(spark: SparkSession, root: str, segments: list[Segment], version: int) -> int:
    """Write the table of a version; a second writer of the same number fails."""
    rows = [(i, s.path, s.buckets, s.documents, s.dropped, s.id_bytes, s.fold_accents) for i, s in enumerate(segments)]
    spark.createDataFrame(rows, VERSION_DDL).coalesce(1).write.mode("errorifexists").parquet(
        f"{root}/versions/version={version}")
    return version


def branch(spark: SparkSession, root: str, source: str, version: int | None = None) -> int:
    """A new index at ``root`` that begins with the segments of another, which stay where they are."""
    return publish(spark, root, segments_of(spark, source, version), 1)


# ---- segments

def _name(path: str, kind: str) -> str:
    """A table name that belongs to one path."""
    return f"segment_{hashlib.md5(path.encode()).hexdigest()}_{kind}"


def _table(spark: SparkSession, segment: Segment, kind: str) -> DataFrame:
    return open_bucketed(spark, _name(segment.path, kind), f"{segment.path}/{kind}", "product_id", segment.buckets,
                         *ORDERS[kind])


def _write(df: DataFrame, path: str, kind: str, buckets: int) -> DataFrame:
    return write_bucketed(df, _name(path, kind), f"{path}/{kind}", "product_id", buckets, *ORDERS[kind])


def _counted_offers(docs: DataFrame, sign: int) -> DataFrame:
    """Offers with the number of documents that make them, negative for documents that go."""
    return suggestion_offers(docs, distinct=False).groupBy("suggestion", "priority", "key").agg(
        (F.count("*") * sign).alias("n"))


def _write_segment(path: str, buckets: int, fold_accents: bool, documents: DataFrame, embeddings: DataFrame,
                   grams: DataFrame | None, offers: DataFrame | None, dropped: DataFrame, first: bool) -> Segment:
    """``documents`` are read once; all that is cut from them, also grams and offers that are not given, is cut
    from the table written. The tables do not need each other and are written side by side."""
    docs = _write(documents, path, "documents", buckets)

    def count_dropped():
        return _write(dropped, path, "dropped", buckets).agg(
            F.count("*"), F.coalesce(F.sum(F.octet_length("product_id")), F.lit(0))).first()

    steps = [
        lambda: write_sorted(field_values(docs, fold_accents), f"{path}/values", "value_key", "product_id"),
        lambda: _write(postings(docs), path, "postings", buckets),
        lambda: write_sorted(trigram_index(docs, fold_accents) if grams is None else grams,
                             f"{path}/trigrams", "gram", "value_key"),
        lambda: write_sorted(_counted_offers(docs, 1) if offers is None else offers,
                             f"{path}/offers", "key", "suggestion"),
        lambda: _write(embeddings, path, "embeddings", buckets),
        count_dropped, lambda: docs.count() if first else 0]
    with ThreadPoolExecutor(len(steps)) as pool:
        *_, gone, count = pool.map(lambda step: step(), steps)
    return Segment(0, path, buckets, count, gone[0], gone[1], fold_accents)


NONE_DROPPED = "product_id string, document boolean, vector boolean"


def _whole(spark: SparkSession, root: str, documents: DataFrame, embeddings: DataFrame, buckets: int,
           fold_accents: bool) -> Segment:
    """One segment that holds everything."""
    return _write_segment(f"{root}/segments/{uuid.uuid4().hex}", buckets, fold_accents, documents, embeddings,
                          None, None, spark.createDataFrame([], NONE_DROPPED), True)


def create(root: str, documents: DataFrame, embeddings: DataFrame, buckets: int, fold_accents: bool = False) -> int:
    """A new index at ``root``, or a rebuilt one as its next version; returns the version."""
    spark = documents.sparkSession
    try:
        number = max(versions(spark, root)) + 1
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        number = 1
    return publish(spark, root, [_whole(spark, root, documents, embeddings, buckets, fold_accents)], number)


# ---- reading

def _live(spark: SparkSession, segments: list[Segment], kind: str, flag: str) -> DataFrame:
    """Rows of all segments, each without the ids that later ones drop."""
    parts = []
    for i, segment in enumerate(segments):
        rows = _table(spark, segment, kind) if kind in ORDERS else spark.read.parquet(f"{segment.path}/{kind}")
        later = [s for s in segments[i + 1:] if s.dropped]
        if later:
            keys = reduce(DataFrame.unionByName, [
                _table(spark, s, "dropped").filter(flag).select("product_id") for s in later])
            few = sum(s.id_bytes for s in later) <= FEW_ID_BYTES
            rows = rows.join(F.broadcast(keys) if few else keys, "product_id", "left_anti").select(*rows.columns)
        parts.append(rows)
    return reduce(DataFrame.unionByName, [p.select(*parts[0].columns) for p in parts])


def read(spark: SparkSession, root: str, version: int | None = None) -> SearchIndex:
    """The index as a version has it, the newest if none is named."""
    segments = segments_of(spark, root, version)
    paths = [s.path for s in segments]
    offers = spark.read.parquet(*[f"{p}/offers" for p in paths])
    if len(segments) > 1:
        offers = offers.groupBy("suggestion", "priority", "key").agg(F.sum("n").alias("n")).filter("n > 0")
    return SearchIndex(
        _live(spark, segments, "documents", "document"), _live(spark, segments, "embeddings", "vector"),
        _live(spark, segments, "postings", "document"),
        # A value is cut up in the first segment that has it; values that no document holds match none.
        spark.read.parquet(*[f"{p}/trigrams" for p in paths]), offers.select("suggestion", "priority", "key"),
        _live(spark, segments, "values", "document"))


# ---- changes

def change(spark: SparkSession, root: str, *, documents: DataFrame | None = None, embeddings: DataFrame | None = None,
           deleted: DataFrame | None = None) -> int:
    """Put changed documents and vectors in their place and drop deleted ids; returns the new version.

    Writes one segment, in proportion to the change. Repeating a change
    changes nothing that is read. Ids both changed and deleted are deleted; the
    vectors of deleted ids go too. Of repeated ids in ``documents`` or
    ``embeddings`` all rows are kept, as in a first build.
    """
    number = max(versions(spark, root))
    segments = segments_of(spark, root, number)
    index, last = read(spark, root, number), segments[0]
    gone = stored((index.documents.limit(0) if deleted is None else deleted).select("product_id").distinct(), "gone")

    def fresh(rows, old, name):
        rows = old.limit(0) if rows is None else rows.join(gone, "product_id", "left_anti")
        return stored(rows.select(*old.columns), name)

    docs, vectors = fresh(documents, index.documents, "changed"), fresh(embeddings, index.embeddings, "vectors")
    marks = [(docs, True, False), (vectors, False, True), (gone, True, True)]
    dropped = stored(reduce(DataFrame.unionByName, [
        rows.select("product_id", F.lit(d).alias("document"), F.lit(v).alias("vector")) for rows, d, v in marks])
        .groupBy("product_id").agg(F.max("document").alias("document"), F.max("vector").alias("vector")), "dropped")
    replaced = index.documents.join(dropped.filter("document").select("product_id"), "product_id", "left_semi")
    offers = _counted_offers(docs, 1).unionByName(_counted_offers(replaced, -1)).groupBy(
        "suggestion", "priority", "key").agg(F.sum("n").alias("n")).filter("n <> 0")
    grams = trigram_index(docs, last.fold_accents)
    known = index.trigrams.select("field", "value_key").join(
        grams.select("field", "value_key").distinct(), ["field", "value_key"], "left_semi").distinct()
    grams = grams.join(known, ["field", "value_key"], "left_anti").select(*index.trigrams.columns)
    added = _write_segment(f"{root}/segments/{uuid.uuid4().hex}", last.buckets, last.fold_accents, docs, vectors,
                           grams, offers, dropped, False)
    segments = [*segments, added]
    publish(spark, root, segments, number + 1)
    if (len(segments) > MAX_SEGMENTS
            or sum(s.dropped for s in segments[1:]) > MERGE_SHARE * max(1, segments[0].documents)):
        return merge(spark, root)
    return number + 1


def merge(spark: SparkSession, root: str) -> int:
    """Write the newest version as one segment, as the next version."""
    number = max(versions(spark, root))
    first, index = segments_of(spark, root, number)[0], read(spark, root, number)
    return publish(spark, root, [_whole(spark, root, index.documents, index.embeddings, first.buckets,
                                        first.fold_accents)], number + 1)
