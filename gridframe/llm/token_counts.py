"""Token counts from flat token files by a scan for end-of-document identifiers.

A token file is nothing but big-endian ids of 16 or 32 bits, an end-of-document id after each document; there is no
index.  The scan cuts files into blocks that don't heed documents, finds the separators of a block at once, and stitches
documents that cross blocks by a prefix scan over the blocks of a file (separators so far, place of the last separator).

Files are written by Spark's text sink, so that any file system that Spark writes to will do: a row is a chunk of
documents with the end id between them, and the row separator is the end id.  A file has FILE_CHUNKS chunks, so that it
is bounded by its bytes, however long or short its documents are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridframe.llm import common, tokens

BLOCK_BYTES = 1 << 20
#: Bytes of a chunk (a longer document is one of its own) and chunks of a file.
CHUNK_BYTES, FILE_CHUNKS = 1 << 20, 16


def end_of(vocabulary: str) -> int:
    """The end-of-document id: the largest of 16 bits, or of 32 bits if the vocabulary reaches it."""
    return 0xFFFF if tokens.encoder(vocabulary).size <= 0xFFFF else 0xFFFFFFFF


def width(end: int) -> int:
    """Bytes of an id."""
    return 2 if end <= 0xFFFF else 4


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end: int | None = None) -> None:
    """Writes the ids of docs(text) below path, in row order; a task's files are numbered in their order."""
    vocabulary = vocabulary or tokens.default_path()
    end = end_of(vocabulary) if end is None else end
    kind, mark = f">u{width(end)}", end.to_bytes(width(end), "big")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, rows, size = tokens.encoder(vocabulary), [], 0
        if encoder.size > end:
            raise ValueError("the vocabulary reaches the end id")
        chunk = lambda: pa.RecordBatch.from_arrays([pa.array([mark.join(rows)], pa.binary())], ["value"])
        for batch in batches:
            for text in batch.column(0):
                ids = encoder.ids(text.as_py()).astype(kind).tobytes()
                if rows and size + len(ids) > CHUNK_BYTES:
                    yield chunk()
                    rows, size = [], 0
                rows.append(ids)
                size += len(ids) + len(mark)
        if rows:
            yield chunk()

    flat = docs.select("text").mapInArrow(encode, "value binary").select(F.col("value").cast("string").alias("value"))
    flat.write.option("encoding", "ISO-8859-1").option("lineSep", mark.decode("latin-1")).option("maxRecordsPerFile", FILE_CHUNKS).text(path)


def scan(spark: SparkSession, path: str, end: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, ordinal (from 0), start and n_tokens of each document in the token files below path.

    Tokens after the last separator of a file are a document without an end and don't count.  block_bytes is a multiple
    of an id's bytes.
    """
    size = width(end)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).filter("length > 0").select(F.col("path").alias("file"), "length", "content")
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / block_bytes))
    cut = files.select("file", "content", F.explode(blocks).alias("block")).select("file", "block", F.expr(f"substring(content, cast(block * {block_bytes} as int) + 1, {block_bytes})").alias("content"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = np.asarray(batch.column(1)) * (block_bytes // size)
            found = [np.flatnonzero(np.frombuffer(c.as_buffer(), f">u{size}") == end) + f for c, f in zip(batch.column(2), first)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found]), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], ["file", "block", "ends"])

    marked = cut.mapInArrow(search, "file string, block long, ends array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = marked.select(
        "file", "block", "ends", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("seen"),
        F.coalesce(F.max(F.element_at(F.when(F.size("ends") > 0, F.col("ends")), -1)).over(before), F.lit(-1)).alias("last"),
    )
    each = stitched.select("file", "seen", F.concat(F.array(F.col("last").cast("long")), "ends").alias("ends")).filter("size(ends) > 1")
    spans = F.transform(F.sequence(F.lit(1), F.size("ends") - 1), lambda i: F.struct((F.col("seen") + i - 1).alias("ordinal"), (F.get("ends", i - 1) + 1).alias("start"), (F.get("ends", i) - F.get("ends", i - 1) - 1).alias("n_tokens")))
    return each.select("file", F.explode(spans).alias("s")).select("file", F.col("s.ordinal").cast("long").alias("ordinal"), F.col("s.start").alias("start"), F.col("s.n_tokens").alias("n_tokens"))


def counted(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens (without the end id) and start (in its file) of docs(doc_id, text), by writing token files and scanning them.

    A file's name holds its task and its number there, so a document's place among the task's gives its row.  Both scans
    of docs are cut into tasks alike: their least number is fixed, whatever executors come or go.  Null and empty texts
    have 0 tokens; repeated rows count each; an empty table gives no rows; further columns are passed over.
    """
    spark, docs, vocabulary = docs.sparkSession, common.steady(docs), vocabulary or tokens.default_path()
    path, key = common.new_path(spark, "tokens"), "spark.sql.files.minPartitionNum"
    with common.setting(spark, key, spark.conf.get(key, None) or str(spark.sparkContext.defaultParallelism)):
        names = common.stored(docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id"), "names")
        write(docs, path, vocabulary)
    task, number = (F.regexp_extract("file", r, 1).cast("long") for r in (r"/part-(\d+)-[^/]*$", r"-c(\d+)\.[^/]*$"))
    found = common.stored(scan(spark, path, end_of(vocabulary)).select(task.alias("task"), number.alias("number"), "ordinal", "start", "n_tokens"), "scanned")
    if found.count() != names.count():
        raise ValueError("the token files don't hold the documents")
    before = Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    files = found.groupBy("task", "number").agg(F.count(F.lit(1)).alias("n")).select("task", "number", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))  # a row a file
    placed = found.join(files, ["task", "number"]).select((F.shiftleft("task", 33) + F.col("first") + F.col("ordinal")).alias("uid"), "start", "n_tokens")
    return names.join(placed, "uid").select("doc_id", "n_tokens", "start")
