"""Web archives and their two-level capture index.

``write_archives`` puts one gzip member per record into archive files, one
file after the other in each task. ``build_index`` sorts the captures by the
reversed-host key of their URL into compressed blocks of lines; each index
file ends with a sparse directory of its blocks, and the list of index files
is the upper level. ``look_up`` finds the files and then the blocks of a key by
binary search and reads only those ranges; ``read_records`` then reads the
ranges of the archives that hold the captures.

Of records with equal payloads of at least ``least`` bytes, the one with the
largest id is stored in full and the others are revisits that refer to it.

Defined results. A null payload is empty, a null URL has the empty key. A
record without id is never referred to while another one has an id; if none
has, all are stored in full. Rows with the same id and payload are stored in
full if that id is the largest. Empty tables give no rows.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import struct
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from shelfseek.llm import files, text as tx
from shelfseek.operators.joins import lookup_join
from shelfseek.sources.tables import stored

LEAST_BYTES = 1000
ARCHIVE_BYTES = 1 << 30
BLOCK_LINES = 500
#: Captures within this many bytes of an archive are read by one task.
READ_BYTES = 1 << 20
RECORD_DDL = ("key string, page_id {kind}, record_type string, refers_to {kind}, payload_bytes long, "
              "payload_digest string, intact boolean, payload binary")


def url_key(url: Column) -> Column:
    """The URL with its host's labels reversed, so that a domain's captures sort together."""
    name = F.lower(F.regexp_extract(url, "^(?:[^:/?#]+:)?//([^/?#]*)", 1))
    rest = F.regexp_extract(url, "^(?:[^:/?#]+:)?//[^/?#]*([^#]*)", 1)
    return F.coalesce(F.when(name != "", F.concat(
        F.array_join(F.reverse(F.split(name, r"\.")), ","), F.lit(")"), rest)).otherwise(url), F.lit(""))


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def record(kind: str, page_id, url: str | None, payload: bytes, size: int, digest: str,
           refers_to=None) -> bytes:
    """One WARC record with an HTTP response block; a revisit keeps the HTTP header alone."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             f"Content-Length: {size}\r\n\r\n").encode() + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{json.dumps(page_id)}>"),
              ("WARC-Date", "1970-01-01T00:00:00Z"),
              ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(url.splitlines())))
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<urn:page:{json.dumps(refers_to)}>"),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of a record, with its payload (of a revisit: none) and the payload's full size."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n")
                if line.lower().startswith(b"content-length:"))
    number = lambda name: json.loads(fields[name][10:-1]) if name in fields else None
    return {"type": fields["WARC-Type"], "id": number("WARC-Record-ID"),
            "refers_to": number("WARC-Refers-To"), "payload": payload, "size": size,
            "digest": base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()}


def plan_revisits(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """Pages with digest and, for revisits, the id that they refer to.

    Only the digests of repeated payloads are joined; the pages are not
    shuffled where these are proven few.
    """
    hashed = pages.withColumns({"_digest": F.sha1("payload"), "_bytes": F.length("payload")})
    kept = (hashed.filter(F.col("_bytes") >= least).groupBy("_digest")
            .agg(F.max("page_id").alias("_first"), F.count("*").alias("_n"))
            .filter("_n > 1 and _first is not null").select("_digest", "_first"))
    joined = lookup_join(hashed, stored(kept, "warc-firsts"), ["_digest"], "left", ["page_id", "url"])
    other = F.coalesce(F.col("page_id") != F.col("_first"), F.col("_first").isNotNull())
    return joined.withColumn("_refers_to", F.when(other, F.col("_first")))


def write_archives(pages: DataFrame, *, page_id: str = "page_id", url: str = "url",
                   payload: str = "html", least: int = LEAST_BYTES,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page as a record; returns the captures: key, id, archive, offset, length."""
    spark = pages.sparkSession
    folder = files.new_folder(spark, "warc")
    kind = pages.schema[page_id].dataType.simpleString()
    rows = plan_revisits(pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")), least)
    rows = rows.select("page_id", "url", url_key(F.col("url")).alias("key"), "payload", "_digest",
                       "_refers_to")

    def write(batches):
        out, name, at = None, None, 0
        for batch in tx.pieces(batches, "payload", tx.BATCH_BYTES):
            names, offsets, lengths = [], [], []
            for i, u, body, digest, refers in zip(*(
                    batch.column(c).to_pylist() for c in
                    ("page_id", "url", "payload", "_digest", "_refers_to"))):
                if out is None or at >= archive_bytes:
                    if out is not None:
                        out.close()
                    name, at = files.fresh_name(folder, ".warc.gz"), 0
                    out = files.create(name)
                member = _member(record("response" if refers is None else "revisit", i, u, body,
                                        len(body), digest, refers))
                out.write(member)
                names.append(name)
                offsets.append(at)
                lengths.append(len(member))
                at += len(member)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("page_id"), pa.array(names, pa.string()),
                 pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=["key", "page_id", "archive", "offset", "length"])
        if out is not None:
            out.close()

    schema = f"key string, page_id {kind}, archive string, offset long, length long"
    return stored(tx.mapped(rows, write, schema), "warc-captures")


def build_index(captures: DataFrame, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Sort captures into index files; returns the upper level: file, first and last key.

    A file holds gzip blocks of JSON lines, then its block directory (first
    keys, offsets, lengths) and the directory's length. Captures of one key
    are ordered by archive and offset and may fill many blocks and files.
    """
    spark = captures.sparkSession
    folder = files.new_folder(spark, "warc-index")

    def write(batches):
        out, name, at = None, files.fresh_name(folder, ".idx"), 0
        lines, directory = [], []

        def flush():
            nonlocal at
            block = _member("\n".join(json.dumps(x) for x in lines).encode())
            out.write(block)
            directory.append([lines[0][0], lines[-1][0], at, len(block)])
            at += len(block)
            lines.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    out = files.create(name)
                lines.append(row)
                if len(lines) >= block_lines:
                    flush()
        if out is None:
            return
        if lines:
            flush()
        tail = _member(json.dumps(directory).encode())
        out.write(tail + struct.pack("<q", len(tail)))
        out.close()
        yield pa.RecordBatch.from_pydict({"file": [name], "first": [directory[0][0]],
                                          "last": [directory[-1][1]]})

    ordered = captures.select("key", "page_id", "archive", "offset", "length").repartitionByRange(
        "key", "archive", "offset").sortWithinPartitions("key", "archive", "offset")
    return stored(tx.mapped(ordered, write, "file string, first string, last string"), "warc-files")


class IndexFile:
    """An index file opened for range reads, with its block directory."""

    def __init__(self, name: str):
        self.handle = files.open_ranges(name)
        size = self.handle.size()
        (length,) = struct.unpack("<q", files.read_range(self.handle, size - 8, 8))
        self.directory = json.loads(gzip.decompress(
            files.read_range(self.handle, size - 8 - length, length)))
        self.lasts = [d[1] for d in self.directory]
        self.cached, self.lines, self.keys = -1, [], []

    def block(self, number: int) -> list:
        if number != self.cached:
            _, _, at, length = self.directory[number]
            data = gzip.decompress(files.read_range(self.handle, at, length))
            self.lines = [json.loads(x) for x in data.decode().split("\n")]
            self.keys = [x[0] for x in self.lines]
            self.cached = number
        return self.lines

    def find(self, key: str):
        """All captures of a key: binary search among the blocks, then among the lines."""
        number = bisect.bisect_left(self.lasts, key)
        while number < len(self.directory) and self.directory[number][0] <= key:
            lines = self.block(number)
            yield from lines[bisect.bisect_left(self.keys, key):bisect.bisect_right(self.keys, key)]
            number += 1


def look_up(keys: DataFrame, index: DataFrame, kind: str = "bigint") -> DataFrame:
    """The captures of each ``key`` row, by binary search over files, blocks and lines.

    The list of index files has one row per partition of the index, which
    bounds what the driver and the tasks hold of it.
    """
    tx.prepare(keys.sparkSession)
    listed = sorted((r["first"], r["last"], r["file"]) for r in index.collect())
    lasts = [r[1] for r in listed]

    def route(batches):
        for batch in batches:
            out: list[tuple[str, str]] = []
            for key in batch.column(0).to_pylist():
                i = bisect.bisect_left(lasts, key)
                while i < len(listed) and listed[i][0] <= key:
                    out.append((key, listed[i][2]))
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.string()),
                                              pa.array([f for _, f in out], pa.string())],
                                             names=["key", "file"])

    def search(batches):
        name, opened = None, None
        for batch in batches:
            rows: list = []
            for key, file in zip(*(c.to_pylist() for c in batch.columns)):
                if file != name:
                    name, opened = file, IndexFile(file)
                rows.extend(opened.find(key))
            columns = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.string()), pa.array(columns[1], id_type),
                 pa.array(columns[2], pa.string()), pa.array(columns[3], pa.int64()),
                 pa.array(columns[4], pa.int64())],
                names=["key", "page_id", "archive", "offset", "length"])

    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    routed = keys.mapInArrow(route, "key string, file string")
    return (routed.repartition("file").sortWithinPartitions("file", "key")
            .mapInArrow(search, f"key string, page_id {kind}, archive string, offset long, length long"))


def read_records(captures: DataFrame, kind: str = "bigint", payloads: bool = True) -> DataFrame:
    """The records of captures, read by range; columns of ``RECORD_DDL``.

    ``intact`` tells whether the digest of the payload just read is the
    recorded one; a revisit's size and digest are those of the full payload.
    Without ``payloads`` that column is null.
    """
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]

    def read(batches):
        name, handle = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part, rows = batch.slice(start, 200), []
                for key, archive, offset, length in zip(*(
                        part.column(c).to_pylist() for c in ("key", "archive", "offset", "length"))):
                    if archive != name:
                        name, handle = archive, files.open_ranges(archive)
                    found = parse(gzip.decompress(files.read_range(handle, offset, length)))
                    full = found["type"] == "response"
                    digest = hashlib.sha1(found["payload"]).hexdigest() if full else found["digest"]
                    rows.append((key, found["id"], found["type"], found["refers_to"],
                                 len(found["payload"]) if full else found["size"], digest,
                                 digest == found["digest"],
                                 found["payload"] if payloads and full else None))
                kinds = [pa.string(), id_type, pa.string(), id_type, pa.int64(), pa.string(),
                         pa.bool_(), pa.binary()]
                names = ["key", "page_id", "record_type", "refers_to", "payload_bytes",
                         "payload_digest", "intact", "payload"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    # A small row stands for much reading, so partitions are not merged by their bytes.
    tasks = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = captures.withColumn("_part", F.expr(f"offset div {READ_BYTES}")).repartition(
        tasks, "archive", "_part").sortWithinPartitions("archive", "offset")
    return tx.mapped(dealt.drop("_part"), read, RECORD_DDL.format(kind=kind))


def report(pages: DataFrame) -> DataFrame:
    """Write all pages, index them, look every URL up again and describe the records read back."""
    index = build_index(write_archives(pages))
    keys = pages.select(url_key(F.col("url")).alias("key")).distinct()
    found = look_up(keys, index)
    return read_records(found, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
