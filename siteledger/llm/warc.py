"""WARC archives: write records with an index, then read selected records by byte ranges.

Each record is a gzip member of its own. They go out through Spark's text writer, whose separator
is an empty gzip member, so a task's file is a valid compressed archive on any store that Spark can
reach, and only files of tasks that succeeded stay. One pass over the archives makes the index
(file, offset, length, URL, digest). Reading starts from the index: selected records are sorted by
offset, near ranges become one read, and each record is cut out of its range.

Records with equal payloads of at least min_bytes bytes: the one with the smallest id is a response,
the others revisit it. Null payloads count as empty; a null URL is written as an empty target. Rows with
a null id are left out of the choice of a response and written as responses. Repeated ids keep their
rows. An empty table gives no archive and no rows. Only the named columns are read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteledger.llm.shared import cut, new_path

CLOSE = b"\r\n\r\n"
LINE_END = re.compile(r"\r\n|\r|\n")
#: An empty gzip member.
EMPTY = gzip.compress(b"", mtime=0)
#: Bytes between two selected records that are still read over, and the longest range of many records.
GAP, RANGE = 1 << 16, 8 << 20
#: Bytes of payload that one archive file is to hold.
FILE_BYTES = 32 << 20


def base32(hex_: Column) -> Column:
    """Upper-case base32 of a digest of 40 hex digits, which needs no padding."""
    # fixed values: the alphabet of RFC 4648
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for k in range(0, 40, 5):
        n = F.conv(F.substring(hex_, k + 1, 5), 16, 10).cast("int")
        out += [F.substring(alphabet, F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def records(pages: DataFrame, min_bytes: int, id_col: str, url_col: str, payload_col: str) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to."""
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"),
    ).withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("sha", F.sha1(F.col("payload").cast("binary")))
    shared = (
        base.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
        .groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first_id")
    )
    # written first: Spark broadcasts it if the table is small, else both sides are plain exchanges, which it splits where a digest is hot
    joined = base.join(cut(shared, "digests"), "sha", "left")
    revisit = F.col("first_id").isNotNull() & (F.col("payload_bytes") >= min_bytes) & (F.col("page_id") > F.col("first_id"))
    return joined.select(
        "page_id", "url", "payload", "payload_bytes", base32(F.col("sha")).alias("payload_digest"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


def member(row: dict, date: str) -> bytes:
    """One record, compressed. A revisit has no block; its payload's length stays in an extension field."""
    block = row["payload"].encode() if row["record_type"] == "response" else b""
    name = lambda n: f"<urn:siteledger:page:{'none' if n is None else n}>"
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {name(row['page_id'])}", f"WARC-Date: {date}", f"WARC-Target-URI: {LINE_END.sub(' ', row['url'])}",
        f"WARC-Payload-Digest: sha1:{row['payload_digest']}", f"X-Payload-Length: {row['payload_bytes']}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}",
    ]
    if row["record_type"] == "revisit":
        head += [f"WARC-Refers-To: {name(row['refers_to'])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return gzip.compress("\r\n".join(head).encode() + CLOSE + block + CLOSE, 6, mtime=0)


def parsed(record: bytes) -> dict:
    """Fields of an uncompressed record, and its block."""
    head, _, rest = record.partition(CLOSE)
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda k: None if fields.get(k, "none>").endswith("none>") else int(fields[k].rpartition(":")[2].rstrip(">"))
    return {
        "page_id": number("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": int(fields["X-Payload-Length"]), "refers_to": number("WARC-Refers-To"), "block": rest[: int(fields["Content-Length"])],
    }


def members(content: memoryview) -> Iterator[tuple[int, int, bytes]]:
    """offset, length and bytes of each gzip member that isn't empty."""
    at = 0
    while at < len(content):
        z, parts, end = zlib.decompressobj(31), [], at
        while not z.eof:
            if end >= len(content):
                raise ValueError("an archive ends within a record")
            step = content[end : end + 8192]
            parts.append(z.decompress(step))
            end += len(step)
        end -= len(z.unused_data)
        if body := b"".join(parts):
            yield at, end - at, body
        at = end


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write one archive for each shard, of about FILE_BYTES of payload, under path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                rows = batch.slice(k, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"] for r in rows], pa.int64()), pa.array([member(r, date) for r in rows], pa.binary())], names=["shard", "record"])

    total = pages.agg(F.sum(F.octet_length(F.col(payload_col)).cast("long"))).first()[0] or 0
    n = max(1, -(-total // FILE_BYTES), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = records(pages, min_bytes, id_col, url_col, payload_col).withColumn("shard", F.pmod(F.xxhash64("page_id", "url", "payload_digest"), F.lit(n)).cast("int"))
    # a shard is one task, in one order, so it has one file
    out = rows.repartitionById(n, F.col("shard")).sortWithinPartitions("shard", "page_id", "payload_digest").mapInArrow(run, "shard long, record binary")
    out.select("shard", F.col("record").cast("string")).write.partitionBy("shard").option("lineSep", EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").text(path)


def index(pages_path: str, spark) -> DataFrame:
    """file, offset, length, page_id, url, payload_digest, record_type of every record in the archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [{"file": file, "offset": at, "length": n} | parsed(body) for at, n, body in members(memoryview(content.as_buffer()))]
                yield pa.RecordBatch.from_pylist([{k: r[k] for k in INDEX.names} for r in found], schema=INDEX)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(pages_path)
    return files.select("path", "content").mapInArrow(run, "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string")


INDEX = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_digest", pa.string()), ("record_type", pa.string())])
BACK = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_())])


def ranges(rows: list[tuple[int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Sorted (offset, length) in runs that one read covers."""
    held: list[tuple[int, int]] = []
    for at, n in rows:
        if held and (at - (held[-1][0] + held[-1][1]) > GAP or at + n - held[0][0] > RANGE):
            yield held
            held = []
        held.append((at, n))
    if held:
        yield held


def read(selected: DataFrame) -> DataFrame:
    """The records that an index's rows point to: page_id, url, payload (null for revisits), payload_bytes,
    payload_digest, record_type, refers_to, intact (the digest of a response's payload was right)."""

    def fetch(file: str, rows: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        store, name = fs.FileSystem.from_uri(file.replace("file:/", "file:///") if file.startswith("file:/") and not file.startswith("file://") else file)
        with store.open_input_file(name) as f:
            for run in ranges(rows):
                base = run[0][0]
                f.seek(base)
                got = memoryview(f.read(run[-1][0] + run[-1][1] - base))
                out = []
                for at, n in run:
                    r = parsed(gzip.decompress(got[at - base : at - base + n]))
                    body = r.pop("block")
                    whole = r["record_type"] == "response"
                    out.append(r | {"payload": body if whole else None, "intact": not whole or base64.b32encode(hashlib.sha1(body).digest()).decode() == r["payload_digest"]})
                yield pa.RecordBatch.from_pylist(out, schema=BACK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, rows = None, []
        for batch in batches:
            for name, at, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if name != file and rows:
                    yield from fetch(file, rows)
                    rows = []
                file = name
                rows.append((at, n))
        if rows:
            yield from fetch(file, rows)

    n = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = selected.select("file", "offset", "length").repartition(n, "file").sortWithinPartitions("file", "offset")
    return placed.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean")


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, index the archives, and read every record back through the index."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write(pages, f"{path}/archives", min_bytes)
    return read(cut(index(f"{path}/archives", spark), "warc-index"))
