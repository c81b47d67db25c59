"""Near-duplicates by bottom-k sketches of one hash function.

A document's set holds the hashes of its distinct shingles, a text with fewer
words being one shingle. Documents with equal sets are one class from the
start. Of the other sets:

1. The ``LISTED`` smallest hashes of each set go into inverted lists. Short
   lists give all their pairs, with the overlap they count. A list longer than
   ``LONG_LIST`` pairs its members with one hub; only sets with enough hashes in
   long lists can be similar through those alone, the others have left them.
2. Pairs whose overlap can reach that of similar sets have the similarity
   of their union sketches estimated; clearly different ones drop out.
3. The exact Jaccard similarity of the whole sets confirms a link.
4. Long lists hold families of sets of which many, but not all, are similar.
   Members outside the largest component of a family are compared with all
   others of it, block by block, so that no link through a long list is missed.

A similar pair is missed only if fewer than ``LEAST_SHARED`` of the ``LISTED``, or
``LEAST_SKETCH`` of the ``SKETCH``, smallest hashes of its union are common: a chance
below one in a million for a pair just at the threshold.

Defined results. A null or empty text has no shingles, is linked with nothing
and is kept. Repeated rows have equal sets. Documents without an id take part,
but give a component no id as long as another document has one; the component
of such documents alone is null and they are kept. ``unique_documents`` leaves
one row per component, whatever repeats. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from shelfseek.llm import text as tx
from shelfseek.llm.components import connected
from shelfseek.operators.joins import salted_join
from shelfseek.sources.tables import shuffles_dropped, stored, stored_by

SHINGLE = 4
#: Similarity in percent.
SIMILAR = 80
SKETCH = 64
LISTED = 24
LONG_LIST = 16
LEAST_SHARED = 8
#: The same for whole sketches.
LEAST_SKETCH = 32
#: Smallest hashes under which a set is listed in long lists: the chance that similar sets share none
#: of them is below one in a hundred million.
CROWD_LISTED = 12
#: Six standard deviations of the estimate below the threshold.
LEAST_ESTIMATE = 0.5
#: Sets in a block of a group of pairs and of a family, and hashes in all sets of a block.
RUN, BLOCK, BLOCK_HASHES = 512, 2048, 1 << 20
#: Bits for each marked key, and bits at most.
KEY_BITS, MOST_BITS = 16, 1 << 26


def shingle_sets(batch: pa.RecordBatch, column: str, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    buf, offsets = tx.flat(batch.column(column))
    buf = tx.LOWER[buf]
    starts, ends, first = tx.word_bounds(buf, offsets, tx.SPACES)
    words = tx.run_hashes(buf, starts, ends)
    windows = tx.window_hashes(words, width)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        part = windows[a:b - width + 1] if n >= width else tx.window_hashes(words[a:b], n) if n else words[:0]
        out.append(np.unique(part))
    return out


def _digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def sketches(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``text_hash``, ``n`` (set size), ``node`` (digest of the set) and ``sketch`` per row."""
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = source.schema["doc_id"].dataType.simpleString()

    def make(batches):
        for batch in tx.pieces(batches, "text"):
            sets = shingle_sets(batch, "text", width)
            flipped = [(s[:SKETCH] ^ np.uint64(1 << 63)).view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([_digest(s) for s in sets], pa.binary()),
                 pa.array(flipped, pa.list_(pa.int64()))],
                names=["doc_id", "text_hash", "n", "node", "sketch"])

    return tx.mapped(source, make,
                     f"doc_id {kind}, text_hash long, n long, node binary, sketch array<long>")


def _size_fits(a: str, b: str):
    return (F.col(a) * 100 >= F.col(b) * SIMILAR) & (F.col(b) * 100 >= F.col(a) * SIMILAR)


def _needed(n):
    """The least overlap of sketches that sets of similar sizes, the larger of size n, need."""
    return F.least(F.lit(LEAST_SHARED), F.ceil(n * SIMILAR / 100))


def crowded(sets: DataFrame) -> DataFrame:
    """Lists (``value``, ``node``, ``n``) of the sets whose links may go through long lists alone.

    Similar sets share at least ``LEAST_SKETCH`` of their sketches, so a set leaves
    if fewer of its hashes occur twice among these sets. The least hash that two
    similar sets share is among the ``CROWD_LISTED`` smallest of both, so that a set
    is listed under those only.
    """
    lists = sets.select("node", "n", F.posexplode("sketch").alias("place", "value"))
    twice = lists.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    kept = lists.join(twice, "value").groupBy("node", "n").agg(
        F.count("*").alias("found"),
        F.collect_list(F.when(F.col("place") < CROWD_LISTED, F.col("value"))).alias("values"))
    return kept.filter(F.col("found") >= F.least(F.lit(LEAST_SKETCH), F.ceil(F.col("n") * SIMILAR / 100))
                       ).select(F.explode("values").alias("value"), "node", "n")


def candidates(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a``, ``b`` with the larger size ``n``, and all (``hub``, ``node``, ``n``) of long lists."""
    lists = sets.select("node", "n", F.explode(F.slice("sketch", 1, LISTED)).alias("value"))
    shared = lists.groupBy("value").agg(F.count("*").alias("df")).filter("df > 1")
    long_list = F.col("df") > LONG_LIST
    # At most LISTED values of a set are gathered.
    entries = stored(lists.join(shared, "value").groupBy("node", "n").agg(
        F.count_if(long_list).alias("hot"), F.collect_list(F.when(~long_list, F.col("value"))).alias("short")),
        "lists")
    short = entries.select("node", "n", "hot", F.explode("short").alias("value"))
    side = lambda c: short.select("value", F.col("node").alias(c), F.col("n").alias(f"n{c}"),
                                  F.col("hot").alias(f"h{c}"))
    met = side("a").join(side("b"), "value").filter((F.col("a") < F.col("b")) & _size_fits("na", "nb"))
    enough = F.col("hot") >= _needed(F.col("n"))
    crowd = crowded(entries.filter(enough).select("node").join(sets, "node"))
    # Each list has another hub, so that a set meets several.
    hubs = crowd.groupBy("value").agg(F.min_by(F.struct("node", "n"), F.xxhash64("value", "node")).alias("hub"))
    around = stored(crowd.join(hubs, "value").groupBy("node", "n", F.col("hub.node").alias("hub"), F.col(
        "hub.n").alias("hub_n")).agg(F.lit(1).alias("_")).drop("_"), "around-hubs")
    through = around.filter((F.col("hub") != F.col("node")) & _size_fits("hub_n", "n")).select(
        F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"), F.col("hub_n").alias("na"),
        F.col("n").alias("nb"))
    overlap = met.select("a", "b", F.least("ha", "hb").alias("more"), F.greatest("na", "nb").alias("n"),
                         F.lit(False).alias("hub"))
    pairs = overlap.unionByName(through.select(
        "a", "b", F.lit(0).cast("long").alias("more"), F.greatest("na", "nb").alias("n"),
        F.lit(True).alias("hub"))).groupBy("a", "b", "n").agg(
            F.count_if(~F.col("hub")).alias("weight"), F.max("more").alias("more"), F.max("hub").alias("hub"))
    return pairs.filter(F.col("hub") | (F.col("weight") + F.col("more") >= _needed(F.col("n")))).select(
        "a", "b", "n"), around


def estimated(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose union sketches do not rule out similarity."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("sketch").alias(f"_{c}"))
    union = F.slice(F.array_sort(F.array_union("_a", "_b")), 1, SKETCH)
    both = F.array_intersect(F.array_intersect(union, "_a"), "_b")
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .filter(F.size(both) >= LEAST_ESTIMATE * F.size(union)).select(*pairs.columns))


def marks(keys: DataFrame) -> np.ndarray:
    """A table of bits with two set for each ``key``, as words; its size is bounded however many keys there are."""
    words = 1 << max(0, (min(keys.count() * KEY_BITS, MOST_BITS) - 1).bit_length() - 6)
    places = F.array(F.col("key"), F.shiftrightunsigned("key", 32))
    at = keys.select(F.explode(places).alias("at")).select(F.col("at").bitwiseAND(F.lit(words * 64 - 1)).alias("at"))
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(words, np.int64)
    table[found["word"].to_numpy()] = found["bits"].to_numpy()
    return table.view(np.uint64)


def marked(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether both bits of each key are set: of all keys that ``table`` was made of, and of few others."""
    keys = keys.view(np.uint64)
    out = np.ones(len(keys), bool)
    for at in (keys, keys >> np.uint64(32)):
        at = at & np.uint64(len(table) * 64 - 1)
        out &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return out


def full_sets(docs: DataFrame, owners: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``node`` and ``hashes`` (the whole set) of the nodes of ``owners`` (``node``, ``doc_id``, ``text_hash``).

    No text moves: tasks leave out rows without the marks of an owner, and the digest of a set tells whose it is.
    """
    key = F.xxhash64("doc_id", "text_hash").alias("key")
    table = docs.sparkSession.sparkContext.broadcast(marks(owners.select(key)))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).select(key, "text")

    def make(batches):
        wanted = (b.filter(pa.array(marked(table.value, b.column(0).to_numpy()), pa.bool_())) for b in batches)
        for batch in tx.pieces(wanted, "text"):
            sets = shingle_sets(batch, "text", width)
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()),
                                              pa.array([s.tobytes() for s in sets], pa.binary())],
                                             names=["node", "hashes"])

    found = tx.mapped(rows, make, "node binary, hashes binary").dropDuplicates(["node"])
    return found.join(owners.select("node"), "node", "left_semi")


def _blocks(most: int, name: str):
    """Into how many blocks sets go that have ``n`` hashes each."""
    return F.ceil(F.greatest(F.count("*") / most, F.sum("n") / BLOCK_HASHES)).cast("int").alias(name)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """The pairs ``a``, ``b`` whose whole sets are similar, in either order; ``n`` is the larger set's size.

    Pairs with the same least set around them form a group. In it the end with fewer partners meets the other one in
    a block of both, so that a set travels once per block that it meets and not once per partner.
    """
    near = pairs.select(F.explode(F.array("a", "b")).alias("node"), "a").groupBy("node").agg(
        F.min("a").alias("low"), F.count("*").alias("partners"))
    side = lambda c: near.select(F.col("node").alias(c), F.struct("partners", "node", "low").alias(f"_{c}"))
    grouped = stored(pairs.join(side("a"), "a").join(side("b"), "b").select(
        "n", F.least("_a.low", "_b.low").alias("group"), F.least("_a", "_b")["node"].alias("few"),
        F.greatest("_a", "_b")["node"].alias("many")), "groups")
    count = lambda c: grouped.groupBy("group", c).agg(F.max("n").alias("n")).groupBy("group").agg(
        _blocks(RUN, f"all_{c}"))
    number = lambda c: F.pmod(F.xxhash64(c), F.col(f"all_{c}")).cast("int").alias(f"of_{c}")
    keys = ["group", "of_few", "of_many"]
    counts = count("few").join(count("many"), "group")
    placed = stored(salted_join(grouped, counts, ["group"], "inner", ["few", "many"]).select(
        "group", number("few"), number("many"), "few", "many"), "runs")
    none = F.lit(None).cast("binary")
    held = placed.select(*keys, F.explode(F.array("few", "many")).alias("node")).distinct().join(sets, "node").select(
        *keys, F.col("node").alias("a"), none.alias("b"), "hashes")
    asked = placed.select(*keys, F.col("few").alias("a"), F.col("many").alias("b"), none.alias("hashes"))

    def compare(batches):
        key, mine = None, {}
        for batch in tx.pieces(batches, "hashes", tx.BATCH_BYTES):
            found: list[tuple[bytes, bytes]] = []
            for *at, a, b, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                if at != key:
                    key, mine = at, {}
                if b is None:
                    mine[a] = np.frombuffer(hashes, np.uint64)
                    continue
                one, other = mine[a], mine[b]
                at = np.searchsorted(one, other)
                at[at == len(one)] = 0
                common = int((one[at] == other).sum())
                if 100 * common >= percent * (len(one) + len(other) - common):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()),
                                              pa.array([b for _, b in found], pa.binary())],
                                             names=["a", "b"])

    dealt = held.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, F.col("b").asc_nulls_first())
    return tx.mapped(dealt, compare, "a binary, b binary")


def common_counts(sets: list[np.ndarray], asking: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each asking set the number of hashes that it shares with each of ``sets``."""
    size = np.array([len(s) for s in sets])
    joined = np.concatenate(sets)
    order = np.argsort(joined, kind="stable")
    joined, owner = joined[order], np.repeat(np.arange(len(sets)), size)[order]
    for values in asking:
        low, high = np.searchsorted(joined, values), np.searchsorted(joined, values, "right")
        n = high - low
        at = np.arange(n.sum()) + np.repeat(low - np.cumsum(n) + n, n)
        yield np.bincount(owner[at], minlength=len(sets))


def outside_links(around: DataFrame, parts: DataFrame, whole: DataFrame, percent: int = SIMILAR
                  ) -> DataFrame | None:
    """Links that hubs have missed, or None if there is nothing left to compare.

    Components that share a long list form a family. Members outside the largest
    component of their family meet all members of other components, in blocks
    of similar sizes; each set travels once per block that it meets. Of the links of
    a set to one component a block reports one.
    """
    root = lambda c, name: parts.select(F.col("node").alias(c), F.col("root").alias(name))
    placed = stored(around.join(root("node", "_root"), "node", "left").join(root("hub", "_hub"), "hub", "left")
                    .select("node", "n", F.coalesce("_root", "node").alias("root"),
                            F.coalesce("_hub", "hub").alias("hub_root")), "around-roots")
    meeting = placed.filter("root <> hub_root").select(F.col("root").alias("a"), F.col("hub_root").alias("b"))
    if meeting.isEmpty():
        return None
    families = connected(meeting).select(F.col("node").alias("root"), F.col("root").alias("family"))
    members = placed.select("node", "n", "root").distinct().join(families, "root")
    sizes = members.groupBy("family", "root").agg(F.count("*").alias("_n"))
    main = sizes.groupBy("family").agg(F.max_by("root", F.struct("_n", "root")).alias("main"))
    # Sets of similar sizes are in the same class or in neighbouring ones.
    level = F.floor(F.log("n") / F.log(F.lit(100 / percent))).cast("int")
    members = stored(members.join(main, "family").select(
        "family", "node", "n", "root", level.alias("level"), (F.col("root") != F.col("main")).alias("outside")), "families")
    asking = members.filter("outside").withColumn(
        "level", F.explode(F.array(*[F.col("level") + k for k in (-1, 0, 1)])))
    # The sets of a class in as few blocks as a task may hold, so that few copies of them travel.
    grid = stored(members.groupBy("family", "level").agg(_blocks(BLOCK, "all_ours")).join(
        asking.groupBy("family", "level").agg(_blocks(BLOCK, "all_theirs")), ["family", "level"]), "blocks")
    number = lambda top: F.pmod(F.xxhash64("node"), F.col(top)).cast("int")
    every = lambda top: F.explode(F.sequence(F.lit(0), F.col(top) - 1))
    keys = ["family", "level", "ours", "theirs"]
    inner = members.join(grid, ["family", "level"]).withColumn("ours", number("all_ours")).select(
        *keys[:3], every("all_theirs").alias("theirs"), "node", "root", F.lit(False).alias("asks"))
    outer = asking.join(grid, ["family", "level"]).withColumn("theirs", number("all_theirs")).select(
        *keys[:2], every("all_ours").alias("ours"), "theirs", "node", "root", F.lit(True).alias("asks"))

    def compare(table: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
        nodes, roots, asks = (table[c].to_pylist() for c in ("node", "root", "asks"))
        here, there = ([i for i, ask in enumerate(asks) if ask == side] for side in (False, True))
        found: dict[tuple, bytes] = {}
        if here and there:
            size = np.array([len(sets[i]) for i in here])
            for i, common in zip(there, common_counts([sets[i] for i in here], [sets[i] for i in there])):
                for k in np.flatnonzero(100 * common >= percent * (size + len(sets[i]) - common)):
                    if roots[here[k]] != roots[i]:
                        found.setdefault((nodes[i], roots[here[k]]), nodes[here[k]])
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()),
                         "b": pa.array(list(found.values()), pa.binary())})

    met = inner.unionByName(outer).join(whole, "node")
    return stored(met.groupBy(*keys).applyInArrow(compare, "a binary, b binary"), "outside-links")


def components(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """Per row ``doc_id``, ``text_hash``, ``n``, ``node``, ``root`` (null without shingles) and ``component_id``.

    The sketches, and the whole sets that are compared, each move once, to be stored by node; what a step has
    shuffled besides is gone when its table is written.
    """
    with shuffles_dropped(docs.sparkSession):
        every = stored(sketches(docs, width), "sketches")
        # One row of each class: that of its least id, or the first of repeated ones.
        key = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
        owners = stored_by(every.filter("n > 0").groupBy("node").agg(F.min_by(
            F.struct("n", "doc_id", "text_hash", "sketch"), key).alias("o")).select("node", "o.*"), "classes", "node")
        pairs, around = candidates(owners)
        pairs = stored(estimated(pairs, owners), "pairs")
        ends = pairs.select(F.col("a").alias("node")).unionByName(
            pairs.select(F.col("b").alias("node"))).unionByName(around.select("node")).distinct()
        wanted = stored(owners.select("node", "doc_id", "text_hash").join(ends, "node"), "wanted")
        whole = stored_by(full_sets(docs, wanted, width), "whole-sets", "node")
        links = stored(confirmed(pairs, whole), "links")
        parts = stored(connected(links), "parts")
        missed = outside_links(around, parts, whole)
        if missed is not None and not missed.isEmpty():
            # A component is a star already, so its links need not be followed again.
            stars = parts.select(F.col("root").alias("a"), F.col("node").alias("b"))
            parts = stored(connected(stars.unionByName(missed)), "parts")
    named = owners.join(parts, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = named.join(least, "root").select("node", "root", "component_id")
    found = every.select("doc_id", "text_hash", "n", "node").join(labels, "node", "left")
    return found.withColumn("component_id", F.when(F.col("n") > 0, F.col("component_id")).otherwise(
        F.col("doc_id")))


def report(docs: DataFrame) -> DataFrame:
    """Set size, component and whether it stays, per document."""
    return components(docs).select(
        "doc_id", F.col("n").alias("n_shingles"), "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def unique_documents(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One document of each component, with its columns: the one with the least id."""
    found = components(docs, width)
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash")
    single = found.filter("n > 0").groupBy("root").agg(F.min(key).alias("k")).select(
        F.col("k.doc_id").alias("_id"), F.col("k.text_hash").alias("_hash"), F.lit(True).alias("_single"))
    none = found.filter("n = 0").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"),
                                        F.lit(False).alias("_single"))
    kept = stored(single.unionByName(none).distinct(), "kept")
    # Null ids would meet in one task; the hash of the text stands in for them.
    # Rows travel as one column, so that no name of theirs meets one of these steps.
    def placed(number, text_hash):
        return F.coalesce(number.cast("string"), F.concat(F.lit("-"), text_hash.cast("string"))).alias("place")

    text_hash = F.xxhash64("text")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                       placed(F.col("doc_id"), text_hash), text_hash.alias("text_hash"))
    kept = kept.select(placed(F.col("_id"), F.col("_hash")), F.col("_hash").alias("text_hash"), "_single").hint("shuffle_hash")
    joined = rows.join(kept, ["place", "text_hash"])
    repeated = joined.filter("_single").dropDuplicates(["place", "text_hash"])
    return repeated.unionByName(joined.filter(~F.col("_single"))).select(
        *[F.col("row")[c].alias(c) for c in docs.columns])
