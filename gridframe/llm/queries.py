"""The queries of the training-data operators over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.llm import bagminhash, common, embedding_dups, fingerprints, packing, pfair, pseudo_likelihood, sharding, token_counts, toxicity, warc

#: Bytes of a shard of documents: so many, or a SHARDS-th of the table if that is less.
SHARD_BYTES, SHARDS = 512 << 20, 64


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived_pages(common.table(spark, sf_dir, "pages"))


def op2_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.scored(common.table(spark, sf_dir, "documents"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(common.table(spark, sf_dir, "documents"))


def op4_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    rows = toxicity.scored(docs, toxicity.fit(toxicity.labelled(docs, labels, fold=2)))
    held = F.coalesce(toxicity.crc(F.col("doc_id")) % 4 == 2, F.lit(False))
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op5_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(common.table(spark, sf_dir, "documents"))


def op6_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.stored(common.table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").alias("size")), "sizes")
    total = docs.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    limit = max(1, min(SHARD_BYTES, -(-total // SHARDS)))
    return sharding.sharded(docs, ["doc_id"], F.col("size"), limit).select("doc_id", "bytes", "shard", "depth", "entry", "shard_bytes", "shard_rows")


def op7_embedding_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dups.classes(common.table(spark, sf_dir, "embeddings"))


def op8_invertible_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(common.table(spark, sf_dir, "documents"))


def op9_bagminhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(common.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op10_pfair_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("uid"), "doc_id", F.col("source").cast("string").alias("source"))
    return pfair.scheduled(common.stored(docs, "mix"), "source", "uid").drop("uid")


QUERIES = {
    "op1_warc_revisits": op1_warc_revisits,
    "op2_pseudo_likelihood": op2_pseudo_likelihood,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_toxicity_grammar": op4_toxicity_grammar,
    "op5_separator_scan": op5_separator_scan,
    "op6_extendible_shards": op6_extendible_shards,
    "op7_embedding_codes": op7_embedding_codes,
    "op8_invertible_fingerprints": op8_invertible_fingerprints,
    "op9_bagminhash_classes": op9_bagminhash_classes,
    "op10_pfair_mixture": op10_pfair_mixture,
}

SQL: dict[str, str] = {
    "op6_extendible_shards": f"""
        WITH b AS (
            SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
                   lpad(bin(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT)), 60, '0') AS bits
            FROM documents),
        t AS (SELECT greatest(1, least({SHARD_BYTES}, ceil(sum(bytes) / {SHARDS}.0)))::BIGINT AS most, sum(bytes) AS total FROM b),
        f AS (SELECT most, CAST(length(bin(CAST(ceil(total / most::DOUBLE) AS BIGINT) - 1)) + 4 AS INTEGER) AS first FROM t),
        lv AS (SELECT unnest(range(0, 41)) AS depth),
        s AS (
            SELECT depth, left(bits, depth) AS shard, sum(bytes) AS shard_bytes, count(*) AS shard_rows
            FROM b, lv GROUP BY 1, 2 HAVING sum(bytes) <= (SELECT most FROM t) OR count(*) = 1),
        p AS (
            SELECT b.doc_id, b.bytes, b.bits, s.*, row_number() OVER (PARTITION BY b.doc_id ORDER BY s.depth) AS k
            FROM b, lv JOIN s ON s.depth = lv.depth AND s.shard = left(b.bits, lv.depth))
        SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, shard, CAST(depth AS INTEGER) AS depth,
               left(bits, first + 12 * greatest(0, CAST(ceil((depth - first) / 12.0) AS INTEGER))) AS entry,
               CAST(shard_bytes AS BIGINT) AS shard_bytes, CAST(shard_rows AS BIGINT) AS shard_rows
        FROM p, f WHERE k = 1""",
    "op1_warc_revisits": """
        WITH p AS (
            SELECT page_id, url, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
        SELECT p.page_id, p.payload_bytes, p.payload_digest,
               CASE WHEN p.page_id <> f.first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN p.page_id <> f.first_id THEN f.first_id END AS refers_to, p.url
        FROM p LEFT JOIN f ON p.payload_bytes >= 100 AND p.payload_digest = f.payload_digest""",
}
