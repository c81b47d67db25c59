"""Mixing sources to target weights by pivotal dependent rounding.

Sources, in code point order with null last, take the weights of a repeating
pattern and share ``share`` times all words; a source stops at ``most`` times its own
words and the excess is shared again by weight. Every document of a source
then gets the same expected number of copies: a whole part, and a fraction
that is rounded.

Rounding pairs a document of a source with smaller ones and moves words
between its fraction and theirs, in a random direction with the odds that
leave all expectations unchanged, until one of them is whole. Each bucket of a
source leaves at most one unfinished document; these meet in larger buckets,
level by level, until one is left per source. It is rounded to the nearer side,
so a source misses its target by at most half of one document, mostly a small one.

The random numbers depend on the seed, the source and the bucket only, and
buckets on the document and the number of rows, so reruns agree on any cluster.

Defined results. A null or empty text has size 0 and takes no words. A null
source is a source of its own. Documents with a null id, and repeated rows,
are separate documents. Empty tables give no rows.
"""

from __future__ import annotations

import random

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfseek.llm import text as tx
from shelfseek.operators.joins import lookup_join
from shelfseek.sources.tables import stored

# Fixed values.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
#: Rows of a bucket on the first level; documents settled at once, and buckets that meet on the next level.
BUCKET_ROWS = 1024
FAN_IN = 64


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Rows numbered from 0 in global order, without bringing them into one task."""
    ranged = stored(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    offset, rows = 0, []
    for r in sorted(ranged.groupBy("_range").count().collect()):
        rows.append((r["_range"], offset))
        offset += r["count"]
    # One row per range.
    offsets = df.sparkSession.createDataFrame(rows, "_range int, _offset long")
    inner = Window.partitionBy("_range").orderBy(*order)
    return ranged.join(F.broadcast(offsets), "_range").withColumn(
        "_number", F.row_number().over(inner) - 1 + F.col("_offset")).drop("_range", "_offset")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE,
                   most: float = MOST) -> DataFrame:
    """``source``, ``source_size`` and ``target`` of every source of ``source``, ``size`` rows."""
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    pattern = F.array(*[F.lit(w) for w in weights])
    ranked = numbered(sources, F.col("source").asc_nulls_last())
    ranked = stored(ranked.withColumn(
        "weight", F.element_at(pattern, (F.col("_number") % len(weights)).cast("int") + 1)).drop("_number"),
        "sources")
    cap = F.col("source_size") * F.lit(most)
    total, weight = ranked.agg(F.sum("source_size"), F.sum("weight")).first()
    level, capped = (total or 0) * share / (weight or 1), -1
    while True:
        above = cap < F.lit(level) * F.col("weight")
        n, taken, rest = ranked.agg(F.count_if(above), F.sum(F.when(above, cap)),
                                    F.sum(F.when(~above, F.col("weight")))).first()
        if n == capped or not rest:
            break
        capped, level = n, ((total or 0) * share - (taken or 0.0)) / rest
    return ranked.select("source", "source_size",
                         F.least(cap, F.lit(float(level)) * F.col("weight")).alias("target"))


def _settle_group(items: list[list], rng: random.Random) -> None:
    """Settle documents, large ones first, each paired with all smaller ones of the group together.

    The smaller ones give or take words by how far each is from being whole,
    so that what is left in the end is a small document's fraction.
    """
    items.sort(key=lambda x: -x[1])
    for i, a in enumerate(items):
        while _open(a) and (rest := [x for x in items[i + 1:] if _open(x)]):
            slack = [min(x[0], x[1] - x[0]) for x in rest]
            total = sum(slack)
            up = min(a[1] - a[0], *(x[0] * total / s for x, s in zip(rest, slack)))
            down = min(a[0], *((x[1] - x[0]) * total / s for x, s in zip(rest, slack)))
            moved = up if rng.random() * (up + down) < down else -down
            a[0] += moved
            for x, s in zip(rest, slack):
                x[0] -= moved * s / total
            for x in (a, *rest):
                if x[0] < 1e-9 * x[1]:
                    x[0] = 0.0
                elif x[0] > (1 - 1e-9) * x[1]:
                    x[0] = x[1]


def _open(item: list) -> bool:
    return 0.0 < item[0] < item[1]


def _round_level(rows: DataFrame, level: int, last: bool, seed: int) -> DataFrame:
    """Round within each source and bucket; at most one row per group stays between 0 and its size.

    Rows come by falling size; ``FAN_IN`` of them are held at a time.
    """
    def finished(held, rng):
        _settle_group(held, rng)
        if last:
            for item in held:
                item[0] = item[1] if 2 * item[0] >= item[1] else 0.0
        return held

    def rounded(batches):
        key, held, rng = None, [], None
        for batch in batches:
            done: list[list] = []
            for source, bucket, position, size, mass, *rest in zip(*(
                    c.to_pylist() for c in batch.columns)):
                if (source, bucket) != key:
                    done += finished(held, rng)
                    key, held = (source, bucket), []
                    rng = random.Random(xxhash.xxh64_intdigest(repr((seed, level, source, bucket))))
                item = [mass, float(size), source, bucket, position, size, *rest]
                if not _open(item):
                    done.append(item)
                    continue
                held.append(item)
                if len(held) == FAN_IN:
                    _settle_group(held, rng)
                    done += [x for x in held if not _open(x)]
                    held = [x for x in held if _open(x)]
            yield _batch(done, batch.schema)
            names = batch.schema
        if held:
            yield _batch(finished(held, rng), names)

    def _batch(items, schema):
        columns = list(zip(*[[x[2], x[3], x[4], x[5], x[0], *x[6:]] for x in items])) or [
            []] * len(schema)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(columns, schema)], names=schema.names)

    ordered = rows.repartition("source", "_bucket").sortWithinPartitions(
        "source", "_bucket", F.desc("size"), "_position")
    return tx.mapped(ordered, rounded, rows.schema)


def dependent_rounding(rows: DataFrame, seed: int = 0) -> DataFrame:
    """Round ``_mass`` (0 to ``size``) of every row to 0 or ``size`` by the reduction tree.

    ``rows`` has ``source``, ``_bucket``, ``_position``, ``size``, ``_mass`` and any others;
    buckets count from 0.
    """
    buckets = (rows.agg(F.max("_bucket")).first()[0] or 0) + 1
    done, level = None, 0
    while True:
        out = stored(_round_level(rows, level, buckets == 1, seed), "rounding")
        if buckets == 1:
            return out if done is None else done.unionByName(out)
        still = (F.col("_mass") > 0) & (F.col("_mass") < F.col("size"))
        whole = out.filter(~still)
        done = whole if done is None else done.unionByName(whole)
        rows = out.filter(still).withColumn("_bucket", F.expr(f"cast(_bucket div {FAN_IN} as int)"))
        buckets, level = -(-buckets // FAN_IN), level + 1


def mixed_sizes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Per document ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``."""
    sized = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "sizes")
    targets = stored(source_targets(sized), "targets")
    rows = sized.count()
    buckets = 1
    while buckets * BUCKET_ROWS < rows:
        buckets *= 2
    # Null is a source: join on a text that tells it from all others.
    named = lambda df: df.withColumn("_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("-")))
    rated = lookup_join(named(sized), named(targets).drop("source"), ["_source"], "inner",
                        ["doc_id", "size"]).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    order = F.xxhash64("doc_id", F.lit(seed))
    parts = rated.select(
        "source", F.pmod(order, F.lit(buckets)).cast("int").alias("_bucket"), order.alias("_position"),
        "size", ((rate - F.floor(rate)) * F.col("size")).alias("_mass"), "doc_id", "source_size", "target",
        F.floor(rate).cast("long").alias("_whole"))
    copies = F.col("_whole") + F.when((F.col("size") > 0) & (F.col("_mass") >= F.col("size")), 1).otherwise(0)
    return dependent_rounding(parts, seed).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
        (copies * F.col("size")).alias("taken"))


def report(docs: DataFrame) -> DataFrame:
    """What the mix takes of every document."""
    return mixed_sizes(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, with ``mix_copy`` from 0.

    Rows that agree in id, source and size share their outcomes in the order of their texts.
    """
    key = F.to_json(F.struct("doc_id", "source", "size")).alias("key")
    outcomes = mixed_sizes(docs, seed).select(key, "copies").groupBy("key").agg(
        F.sort_array(F.collect_list("copies"), asc=False).alias("copies"))
    # Rows travel as one column, so that no name of theirs meets one of these steps.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "mix_copy"]).alias("row")
    sized = docs.select(row, "doc_id", "source", n_words(F.col("text")).alias("size"))
    same = Window.partitionBy("key").orderBy("row.text")
    joined = sized.select("row", key).join(outcomes, "key").withColumn("nth", F.row_number().over(same))
    repeated = joined.withColumn("n", F.element_at("copies", F.col("nth")).cast("int")).filter("n > 0")
    return repeated.select("row", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("copy")).select(
        *[F.col("row")[c].alias(c) for c in docs.columns if c != "mix_copy"], F.col("copy").alias("mix_copy"))
