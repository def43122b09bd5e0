"""WARC archives: written with an index first, read back by coalesced byte ranges.

Each task writes archives of its own (gzip, a member per record) into the shared folder and returns one index row per record:
file, offset, length, URL and digest. The index is a written table, so only archives of tasks that were committed are ever
named by it; a lost task writes new archives under new names. Readers sort the selected index rows of a file by offset, join
neighbouring ranges into one read, and cut the records out of it.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Payloads shorter than this are never revisits.
MIN_REVISIT_BYTES = 1000
#: An archive is closed beyond this many bytes.
ARCHIVE_BYTES = 32 << 20
#: Ranges are read together if no more than GAP bytes lie between them, up to READ bytes.
GAP, READ = 64 << 10, 8 << 20

INDEX = "file string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORDS = "page_id long, url string, record_type string, refers_to long, digest string, payload binary"

# Fixed values of the WARC 1.1 format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def _uri(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:no-url")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """One response, or a revisit of the page ``refers_to`` that holds no payload.

    A record's id is its own, however often a page_id occurs; page ids stand in extension fields, and a revisit names the
    response by the fields that the format has for that: its URI and date.
    """
    head = HTTP_HEAD.format(len(payload)).encode()
    block = head + payload if refers_to is None else head
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Target-URI", _uri(refers_url)), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page-ID", str(refers_to))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _write(batches: Iterator[pa.RecordBatch], folder: str, date: str) -> Iterator[pa.RecordBatch]:
    fs, base = pafs.FileSystem.from_uri(folder)
    out, name, at = None, "", 0
    try:
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, at = fs.open_output_stream(f"{base}/{name}", compression=None), 0
                    info = b"software: tidemill\r\nformat: WARC File Format 1.1\r\n"
                    first = _gzip(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n")
                    out.write(first)
                    at = len(first)
                payload = (html or "").encode("utf-8")
                digest = hashlib.sha1(payload).hexdigest()
                data = _gzip(record(page_id, url, payload, digest, refers_to, refers_url, date))
                out.write(data)
                rows.append((name, at, len(data), url, digest, page_id, "response" if refers_to is None else "revisit"))
                at += len(data)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["file", "offset", "length", "url", "digest", "page_id", "record_type"])
    finally:
        if out is not None:
            out.close()


def first_copies(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """digest, refers_to (the largest page_id), its url, and n of payloads of at least ``min_bytes`` that occur more than once."""
    keyed = pages.select("page_id", "url", _digest(min_bytes).alias("digest")).where("digest is not null")
    latest = F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("latest")
    found = keyed.groupBy("digest").agg(latest, F.count("*").alias("n")).where("n > 1 and latest is not null")
    return found.select("digest", F.col("latest.page_id").alias("refers_to"), F.col("latest.url").alias("refers_url"), "n")


def _digest(min_bytes: int) -> Column:
    """Null for payloads that are never revisits, so that they meet no key."""
    return F.when(F.octet_length("html") >= min_bytes, F.sha1(F.col("html").cast("binary")))


def write(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Archive every row below ``folder`` (a URI all executors reach); the index, as a written table.

    Null payloads are empty ones. Of equal payloads of at least MIN_REVISIT_BYTES the row with the largest id is the
    response, the others revisit it; rows that share that largest id, and rows without an id, are responses. Null URLs
    are written as urn:no-url. An empty table writes no archive and has an empty index.
    """
    spark = df.sparkSession
    common.ship(spark)
    pages = common.pick(df, page_id=id_col, url=url_col, html=payload_col).withColumn("page_id", F.col("page_id").cast("long"))
    firsts = common.written(first_copies(pages), "first_copies")
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    total = firsts.agg(F.sum("n")).first()[0] or 0
    marked = common.salted_join(pages.withColumn("digest", _digest(MIN_REVISIT_BYTES)), firsts, "digest", total, F.xxhash64("page_id", "url"), "left")
    revisit = F.when(F.col("page_id") != F.col("refers_to"), F.col("refers_to"))
    rows = marked.select("page_id", "url", "html", revisit.alias("refers_to"), "refers_url")
    return common.written(rows.mapInArrow(lambda it: _write(common.trimmed(it), folder, date), INDEX), "index")


def parse(data: bytes) -> dict:
    """Header fields, type, ids and payload of one record (uncompressed)."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = rest[: int(fields[b"Content-Length"])]
    kind = fields[b"WARC-Type"].decode()
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda name: int(fields[name]) if name in fields else None
    return {"type": kind, "page_id": number(b"X-Page-ID"), "refers_to": number(b"X-Refers-To-Page-ID"), "digest": fields[b"WARC-Payload-Digest"].decode().removeprefix("sha1:"), "payload": payload if kind == "response" else None}


def _ranges(rows: Iterator[tuple[str, int, int, str]]) -> Iterator[list[tuple[str, int, int, str]]]:
    """Neighbours in a file, as long as one read holds them."""
    group: list = []
    for row in rows:
        if group and (row[0] != group[0][0] or row[1] - group[-1][1] - group[-1][2] > GAP or row[1] + row[2] - group[0][1] > READ):
            yield group
            group = []
        group.append(row)
    if group:
        yield group


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    fs, base = pafs.FileSystem.from_uri(folder)
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    handle, opened = None, None
    for group in _ranges(rows):
        name, first = group[0][0], group[0][1]
        if name != opened:
            if handle:
                handle.close()
            handle, opened = fs.open_input_file(f"{base}/{name}"), name
        handle.seek(first)
        data = io.BytesIO(handle.read(max(o + n for _, o, n, _ in group) - first)).getbuffer()
        out = [(parse(zlib.decompress(data[o - first : o - first + n], 31)), url) for _, o, n, url in group]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([r["page_id"] for r, _ in out], pa.int64()),
                pa.array([u for _, u in out], pa.string()),
                pa.array([r["type"] for r, _ in out], pa.string()),
                pa.array([r["refers_to"] for r, _ in out], pa.int64()),
                pa.array([r["digest"] for r, _ in out], pa.string()),
                pa.array([r["payload"] for r, _ in out], pa.binary()),
            ],
            names=["page_id", "url", "record_type", "refers_to", "digest", "payload"],
        )
    if handle:
        handle.close()


def read(selected: DataFrame, folder: str) -> DataFrame:
    """The records that the index rows in ``selected`` name; payload is null for revisits. Repeated rows read twice."""
    common.ship(selected.sparkSession)
    n = int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = selected.select("file", "offset", "length", "url").repartition(n, "file").sortWithinPartitions("file", "offset")
    return rows.mapInArrow(lambda it: _read(common.trimmed(it), folder), RECORDS)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record as the archives hold it; sizes and digests of revisits are those of the response they name.

    A null page has an empty payload; a page without an id, and rows that share the largest id, are responses.
    """
    folder = common.new_folder(spark, "warc")
    index = write(common.table(spark, sf_dir, "pages"), folder)
    found = read(index, folder).select("page_id", "record_type", "refers_to", "digest", F.octet_length("payload").cast("long").alias("bytes"), F.lower(F.sha1("payload")).alias("sha1"))
    found = common.written(found, "records")
    # a page id can occur with several payloads: a revisit's response is the one with its digest
    revisits = found.withColumn("key", F.when(F.col("record_type") == "revisit", F.concat_ws(":", "refers_to", "digest")))
    targets = revisits.where("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    responses = found.where("record_type = 'response'").select(F.concat_ws(":", "page_id", "digest").alias("key"), "bytes", "sha1")
    origin = targets.join(responses, "key").groupBy("key", "n").agg(F.max("bytes").alias("full"), F.max("sha1").alias("full_sha1"))
    origin = common.written(origin, "origins")
    joined = common.salted_join(revisits, origin, "key", found.count(), F.xxhash64("page_id", "digest"), "left")
    return joined.select("page_id", F.coalesce("bytes", "full").alias("payload_bytes"), F.coalesce("sha1", "full_sha1").alias("payload_digest"), "record_type", "refers_to")
