"""WARC archives with revisit records, through Spark's own readers and writers.

A record is a gzip member of its own, and the blank lines after it are another, so that readers can start at any record;
a crawl that is only read to be deduplicated can have a member a chunk.  Tasks gather records into chunks, which Spark's text sink writes: a chunk is a row and the blank lines' member the line
separator.  So any file system that Spark reaches will do, a lost task's files are never committed, and a file is bounded
by its bytes, however long or short its records are.  Revisits are resolved on headers alone, shuffled by payload digest;
payloads are only read file by file, to be written anew.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import time
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.llm import common

#: Shorter payloads aren't replaced by revisits.
LEAST_BYTES = 100
#: Bytes of a chunk, compressed if its records are members (a longer record is a chunk of its own), chunks of a file, and the compression level.
CHUNK_BYTES, FILE_CHUNKS, LEVEL = 1 << 20, 16, 4
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END, _PIECE = b"\r\n\r\n", 1 << 16
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_FIELD = re.compile(rb"^([^:\r\n]+):[ \t]*(.*?)\r?$", re.M)
_BREAKS = re.compile(r"[\r\n]+")
_SEPARATOR = gzip.compress(_END, mtime=0)

HEADERS = "file string, at long, record_id string, type string, refers_to_id string, uri string, key string, digest string, said_digest string, payload_bytes long, said_bytes long"
_NAMES = [c.split()[0] for c in HEADERS.split(", ")]


def record(fields: list[tuple[str, object]], body: bytes) -> bytes:
    """A record.  Fields without a value are left out; line breaks in a value become spaces."""
    head = "".join(f"{k}: {_BREAKS.sub(' ', str(v))}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{head}Content-Length: {len(body)}\r\n\r\n".encode("utf-8", "surrogatepass") + body


def zipped(data: bytes) -> bytes:
    """A gzip member."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def response(record_id: str, date: str, uri: str | None, key: str | None, payload: bytes) -> bytes:
    digest = "sha256:" + hashlib.sha256(payload).hexdigest()
    fields = [("WARC-Type", "response"), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest), ("X-Row-Key", key), ("Content-Type", "application/http; msgtype=response")]
    return record(fields, _HTTP + payload)


def revisit(record_id: str, date: str, uri: str | None, key: str | None, digest: str | None, size: int, original: str | None, original_uri: str | None) -> bytes:
    """A revisit says the digest and the length of the payload that it leaves out."""
    fields = [
        ("WARC-Type", "revisit"), ("WARC-Record-ID", record_id), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", digest and (digest if ":" in digest else "sha256:" + digest)), ("X-Payload-Length", size),
        ("WARC-Refers-To", original), ("WARC-Refers-To-Target-URI", original_uri), ("WARC-Profile", PROFILE), ("X-Row-Key", key), ("Content-Type", "application/http; msgtype=response"),
    ]
    return record(fields, _HTTP)


def _chunks(records: Iterator[bytes], members: bool) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0

    def chunk() -> pa.RecordBatch:
        data = _SEPARATOR.join(rows) if members else zipped(_END.join(rows))
        return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], ["value"])

    for x in records:
        x = zipped(x) if members else x
        if rows and size + len(x) > CHUNK_BYTES:
            yield chunk()
            rows, size = [], 0
        rows.append(x)
        size += len(x) + len(_SEPARATOR)
    if rows:
        yield chunk()


def _written(rows: DataFrame, make, path: str, members: bool = True) -> None:
    """Writes the records that make(batches of rows) yields, a member each or a member a chunk."""
    flat = rows.mapInArrow(lambda batches: _chunks(make(batches), members), "value binary").select(F.col("value").cast("string").alias("value"))
    with common.setting(rows.sparkSession, common.CLEANUP, "true"):
        flat.write.option("encoding", "ISO-8859-1").option("lineSep", _SEPARATOR.decode("latin-1")).option("maxRecordsPerFile", FILE_CHUNKS).text(path)


def now() -> str:
    return time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())


def write(rows: DataFrame, path: str, date: str | None = None, members: bool = True) -> None:
    """Writes rows(uri, key, payload) as archives below path, a full response for each row; a null payload is empty."""
    run, date = uuid.uuid4().hex, date or now()

    def make(batches):
        from pyspark import TaskContext

        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for uri, key, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                own = uuid.UUID(bytes=hashlib.md5(f"{run}|{part}|{n}".encode()).digest(), version=4)
                yield response(f"<{own.urn}>", date, uri, key, payload.as_buffer().to_pybytes() if payload.is_valid else b"")
                n += 1

    _written(rows.select("uri", F.col("key").cast("string"), F.col("payload").cast("binary")), make, path, members)


def _inflated(data: memoryview) -> Iterator[bytes]:
    """The bytes of gzip members one after the other, piece by piece."""
    at = 0
    while at < len(data):
        unpack = zlib.decompressobj(31)
        while not unpack.eof:
            if at >= len(data):
                raise ValueError("the archive ends within a record")
            piece = data[at : at + _PIECE]
            yield unpack.decompress(piece)
            at += len(piece) - len(unpack.unused_data)


def _blank(buffer: bytearray) -> int:
    """The bytes of blank lines at the start."""
    return next((i for i, x in enumerate(buffer) if x not in b"\r\n"), len(buffer))


def parsed(data: bytes | memoryview) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """Offset (once unzipped), header and payload of each record of an archive, which may be gzip members, one gzip stream or plain."""
    view = memoryview(data)
    stream, buffer, base = _inflated(view) if bytes(view[:2]) == b"\x1f\x8b" else iter([view]), bytearray(), 0
    while True:
        while (end := buffer.find(_END, blank := _blank(buffer))) < 0:
            if (more := next(stream, None)) is None:
                if buffer.strip():
                    raise ValueError(f"no whole record at byte {base}")
                return
            buffer += more
        del buffer[:blank]
        base, end = base + blank, end - blank
        if buffer[:5] != b"WARC/":
            raise ValueError(f"no record at byte {base}")
        head = {k.decode("utf-8", "replace").lower(): v.decode("utf-8", "replace") for k, v in _FIELD.findall(bytes(buffer[: end + 2]))}
        last = end + 4 + int(head["content-length"])
        while len(buffer) < last:
            if (more := next(stream, None)) is None:
                raise ValueError(f"the record at byte {base} is cut off")
            buffer += more
        body = bytes(buffer[end + 4 : last])
        yield base, head, body.partition(_END)[2] if head.get("content-type", "").startswith("application/http") else body
        del buffer[:last]
        base += last


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select(F.col("path").alias("file"), "content")


def _said(digest: str | None) -> str | None:
    """A stated digest: bare for SHA-256, else as it is."""
    return digest.removeprefix("sha256:") if digest else None


def read(spark: SparkSession, path: str) -> DataFrame:
    """The headers of all records in archives below path, with the SHA-256 and the length of the payload as read."""

    def cut(batches):
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = []
                for at, head, body in parsed(memoryview(data.as_buffer())):
                    said = head.get("x-payload-length")
                    rows.append((name, at, head.get("warc-record-id"), head.get("warc-type"), head.get("warc-refers-to"), head.get("warc-target-uri"), head.get("x-row-key"), hashlib.sha256(body).hexdigest(), _said(head.get("warc-payload-digest")), len(body), int(said) if said else None))
                kinds = [pa.int64() if n in ("at", "payload_bytes", "said_bytes") else pa.string() for n in _NAMES]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(_NAMES), kinds)], _NAMES)

    return _files(spark, path).mapInArrow(cut, HEADERS)


def resolved(headers: DataFrame, order: list[Column] | None = None, least: int = LEAST_BYTES) -> DataFrame:
    """headers (stored) with kind, revisit or response, and `first`: the response that a revisit's payload is in.

    Headers are shuffled by payload digest (a revisit's as it states it) and joined to the first response with that
    payload, by `order`, then file and place (nulls last).  A response with `least` bytes or more that isn't the first
    becomes a revisit of it.  Revisits match responses of any length; one whose digest matches none goes by
    WARC-Refers-To; failing that it stays a revisit with a null `first`.
    """
    by = [x for i, c in enumerate(order or []) for x in (c.isNull().alias(f"no{i}"), c.alias(f"by{i}"))]
    rank = F.struct(*by, F.col("file").alias("file"), F.col("at").alias("at"), F.col("record_id").alias("record_id"), F.col("uri").alias("uri"), F.col("key").alias("key"), F.col("digest").alias("digest"), F.col("payload_bytes").alias("payload_bytes"))
    own = F.struct(*[F.col("first")[k].alias(k) for k in ("file", "at", "record_id", "uri", "key", "digest", "payload_bytes")])
    asked = F.when(F.col("type") == "revisit", F.col("said_digest")).otherwise(F.col("digest"))
    known = headers.filter("type in ('response', 'revisit')").withColumn("asked", asked)
    groups = known.groupBy("asked").agg(F.min(F.when(F.col("type") == "response", rank)).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and asked is not null and first is not null")
    groups = common.stored(groups.select("asked", own.alias("first"), "n"), "originals")
    met = common.spread(known.filter("asked is not null"), groups, ["asked"], "n", "left").drop("n")
    met = common.stored(met.unionByName(known.filter("asked is null").withColumn("first", F.lit(None).cast(groups.schema["first"].dataType))), "met")
    same = (F.col("first.file") == F.col("file")) & (F.col("first.at") == F.col("at"))
    again = (F.col("type") == "revisit") | (F.col("first").isNotNull() & ~same & (F.col("payload_bytes") >= least))
    # revisits whose digest is unknown, say of another kind, by the record that they name
    lost = met.filter("type = 'revisit' and first is null and refers_to_id is not null").drop("first")
    counts = lost.groupBy("refers_to_id").agg(F.count(F.lit(1)).alias("n"))
    self_ = F.struct(*[F.col(k).alias(k) for k in ("file", "at", "record_id", "uri", "key", "digest", "payload_bytes")])
    named = met.filter("type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.when(again, F.col("first")).otherwise(self_).alias("first")).join(counts, "refers_to_id")
    found = common.spread(lost, common.stored(named.dropDuplicates(["refers_to_id"]), "named"), ["refers_to_id"], "n", "left").drop("n")
    rest = met.filter("not (type = 'revisit' and first is null and refers_to_id is not null)").unionByName(found)
    return rest.select(*headers.columns, F.when(again, "revisit").otherwise("response").alias("kind"), F.when(again, F.col("first")).alias("first"))


def deduplicate(spark: SparkSession, source: str, target: str, order: list[Column] | None = None, date: str | None = None) -> None:
    """Archives below `source`, which may hold revisits, written anew below `target`: each long payload once, fresh headers.

    See resolved.  A file's decisions meet its bytes, so that payloads aren't shuffled; records keep URI and key and get
    new identifiers.  Records of other kinds than response and revisit are left out.
    """
    run, date = uuid.uuid4().hex, date or now()
    heads = common.new_path(spark, "raw-headers")
    told = common.stored(resolved(common.stored(read(spark, source), "raw-headers", heads), order), "decisions")
    common.drop_path(spark, heads)
    name = lambda file, at: F.md5(F.concat_ws("|", F.lit(run), file, at.cast("string")))
    digest = F.when(F.col("first").isNotNull(), F.col("first.digest")).otherwise(F.when(F.col("type") == "revisit", F.col("said_digest")).otherwise(F.col("digest")))
    each = F.struct(
        "at", "kind", name(F.col("file"), F.col("at")).alias("id"), F.when(F.col("first").isNotNull(), name(F.col("first.file"), F.col("first.at"))).alias("first"), F.col("first.uri").alias("first_uri"), digest.alias("digest"),
        F.coalesce("first.payload_bytes", "said_bytes", "payload_bytes").alias("size"),
    )
    decisions = told.groupBy("file").agg(F.collect_list(each).alias("decisions"))  # the records of a file, which is bounded
    urn = lambda x: x and f"<{uuid.UUID(hex=x, version=4).urn}>"

    def make(batches):
        for batch in batches:
            for data, told in zip(batch.column(0), batch.column(1)):
                by = {d["at"]: d for d in told.as_py()}
                for at, head, body in parsed(memoryview(data.as_buffer())):
                    if (d := by.get(at)) is None:
                        continue
                    uri, key = head.get("warc-target-uri"), head.get("x-row-key")
                    if d["kind"] == "response":
                        yield response(urn(d["id"]), date, uri, key, body)
                    else:
                        yield revisit(urn(d["id"]), date, uri, key, d["digest"], d["size"], urn(d["first"]), d["first_uri"])

    _written(_files(spark, source).join(decisions.hint("shuffle_hash"), "file").select("content", "decisions"), make, target)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes a record for each of pages(page_id, url, html), deduplicates the archives and reads them back.

    page_id, payload_bytes, payload_digest, record_type, refers_to (the response's page_id), url.  A null html is an empty
    payload; a null page_id comes back as null and is response only if no other page has its payload; of rows with one
    page_id and payload the first by file and place is the response; an empty table gives no rows.
    """
    spark = pages.sparkSession
    order = [F.col("key").cast("long")]
    raw, path = common.new_path(spark, "warc-raw"), common.new_path(spark, "warc")
    write(pages.select(F.col("url").alias("uri"), F.col("page_id").alias("key"), F.col("html").alias("payload")), raw, members=False)
    deduplicate(spark, raw, path, order)
    common.drop_path(spark, raw)
    told = resolved(common.stored(read(spark, path), "warc-headers"), order)
    again = F.col("kind") == "revisit"
    return told.select(
        F.col("key").cast("long").alias("page_id"), F.when(again, F.col("first.payload_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"), F.when(again, F.col("first.digest")).otherwise(F.col("digest")).alias("payload_digest"),
        F.col("kind").alias("record_type"), F.col("first.key").cast("long").alias("refers_to"), F.col("uri").alias("url"),
    )
