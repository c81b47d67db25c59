"""URL rules in sorted digest arrays, memory-mapped and probed by vectorised binary search.

A rule is a host and a path beginning with ``/``; it fits the host and all its
subdomains where the URL's path starts with the rule's. Rules are sorted by
the 64-bit xxHash of host + path into shard files. Every pair of a host suffix
and a path prefix of a URL is looked up; a digest found counts only if the
stored full string is equal. The longest rule wins.

Defined results. A null URL, or one without ``://``, has an empty host and
path and fits no rule. Of equal rules with different verdicts ``block`` wins.
Rules with a null part are ignored. A URL that no rule fits gets the
``default`` verdict. Repeated URLs are judged row by row.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfseek.llm import files, text as tx

#: Seed of the digest, the one of the ``xxhash64`` SQL function.
SEED = 42
SHARD_RULES = 4_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    """From the first ``://`` to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


class DigestArray:
    """One shard: sorted digests, offsets and strings of its rules, mapped from its file."""

    def __init__(self, file: str):
        with open(file, "rb") as f:
            header = json.loads(f.readline())
            base = f.tell()
        n = header["rules"]
        self.digests = np.memmap(file, "<u8", "r", base, (n,)) if n else np.zeros(0, "<u8")
        self.ends = np.memmap(file, "<i8", "r", base + 8 * n, (n,)) if n else np.zeros(0, "<i8")
        self.block = np.memmap(file, np.uint8, "r", base + 16 * n, (n,)) if n else np.zeros(0, np.uint8)
        size = header["bytes"]
        self.strings = np.memmap(file, np.uint8, "r", base + 17 * n, (size,)) if size else b""

    def string(self, i: int) -> bytes:
        return bytes(self.strings[(self.ends[i - 1] if i else 0):self.ends[i]])

    def probe(self, digests: np.ndarray, keys: list[bytes]) -> np.ndarray:
        """Number of the rule equal to each key, else -1."""
        found = np.full(len(keys), -1, np.int64)
        low = np.searchsorted(self.digests, digests, "left")
        high = np.searchsorted(self.digests, digests, "right")
        for i in np.flatnonzero(high > low):
            for rule in range(low[i], high[i]):
                if self.string(rule) == keys[i]:
                    found[i] = rule
        return found


def write_rules(rules: DataFrame, shard_rules: int = SHARD_RULES) -> list[dict]:
    """Sort ``host``, ``path``, ``verdict`` rows into shard files; one entry per shard.

    An entry has the file, its digest range and the path lengths that occur.
    """
    spark = rules.sparkSession
    tx.prepare(spark)
    folder = files.new_folder(spark, "url-rules")
    keyed = (rules.filter("host is not null and path is not null and verdict is not null")
             .withColumn("key", F.concat("host", "path"))
             .groupBy("key").agg(F.max(F.col("verdict") == "block").alias("block"),
                                 F.max(F.length("path")).alias("path_length")))
    # Unsigned order of the digest, as numpy sorts it.
    keyed = keyed.withColumn("digest", F.xxhash64("key")).withColumn(
        "place", F.col("digest").bitwiseXOR(F.lit(-(1 << 63))))
    shards = max(1, -(-keyed.count() // shard_rules))

    def write(batches):
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        buf, offsets = tx.flat(table["key"])
        digests = table["digest"].to_numpy().view("u8")
        name = files.fresh_name(folder, ".rules")
        with files.create(name) as out:
            out.write(json.dumps({"rules": len(digests), "bytes": len(buf)}).encode() + b"\n")
            for part in (digests.astype("<u8"), offsets[1:].astype("<i8"),
                         table["block"].to_numpy().astype(np.uint8), buf):
                out.write(np.ascontiguousarray(part).tobytes())
        lengths = sorted({int(x) for x in table["path_length"].to_pylist()})
        yield pa.RecordBatch.from_pydict(
            {"file": [name], "low": [str(int(digests[0]))], "high": [str(int(digests[-1]))],
             "lengths": [lengths]},
            schema=pa.schema([("file", pa.string()), ("low", pa.string()), ("high", pa.string()),
                              ("lengths", pa.list_(pa.int32()))]))

    placed = keyed.repartitionByRange(shards, "place").sortWithinPartitions("place", "key")
    listed = placed.select("key", "digest", "block", "path_length").mapInArrow(
        write, "file string, low string, high string, lengths array<int>").collect()
    out = []
    for row in listed:
        spark.sparkContext.addFile(row["file"])
        out.append({"name": row["file"].rsplit("/", 1)[1], "low": int(row["low"]),
                    "high": int(row["high"]), "lengths": list(row["lengths"])})
    return out


def _suffixes(name: str) -> list[str]:
    found = [name]
    while (dot := name.find(".")) >= 0:
        name = name[dot + 1:]
        found.append(name)
    return found


def judge(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = "allow",
          shard_rules: int = SHARD_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (the longest that fits, or null) and ``verdict``."""
    shards = write_rules(rules, shard_rules)
    lengths = sorted({n for s in shards for n in s["lengths"]})
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*keep, host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))

    def look_up(batches):
        arrays = [(s, DigestArray(SparkFiles.get(s["name"]))) for s in shards]
        for batch in batches:
            keys: list[bytes] = []
            rows: list[int] = []
            texts: list[str] = []
            for row, (h, p) in enumerate(zip(batch.column("host").to_pylist(),
                                             batch.column("path").to_pylist())):
                if not h:
                    continue
                for suffix in _suffixes(h):
                    for n in lengths:
                        if n > len(p):
                            break
                        texts.append(suffix + p[:n])
                        keys.append(texts[-1].encode())
                        rows.append(row)
            digests = np.fromiter((xxhash.xxh64_intdigest(k, SEED) for k in keys), np.uint64, len(keys))
            best: list[str | None] = [None] * batch.num_rows
            blocked = [default == "block"] * batch.num_rows
            for _, array in arrays:
                hits = array.probe(digests, keys)
                for i in np.flatnonzero(hits >= 0):
                    row = rows[i]
                    if best[row] is None or len(texts[i]) > len(best[row]):
                        best[row], blocked[row] = texts[i], bool(array.block[hits[i]])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(best, pa.string()),
                 pa.array(["block" if b else "allow" for b in blocked], pa.string())],
                names=[*batch.schema.names, "rule", "verdict"])

    schema = split.withColumns({"rule": F.lit("").cast("string"), "verdict": F.lit("")}).schema
    for field in schema:
        field.nullable = True
    return tx.mapped(split, look_up, schema)


def default_rules(spark: SparkSession) -> DataFrame:
    """The rules of the registered query, as host and path."""
    # Fixed values.
    rows = [("com", "/", "allow"), ("example.com", "/en/", "block"),
            ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
            ("net", "/fr/", "block")]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def report(pages: DataFrame) -> DataFrame:
    """Host, path, rule and verdict of every page."""
    return judge(pages.select("page_id", "url"), default_rules(pages.sparkSession)).select(
        "page_id", "host", "path", "rule", "verdict")
