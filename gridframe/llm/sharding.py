"""Sharding by extendible hashing, in DataFrame functions only.

A shard is a prefix of hash bits.  A bucket over its byte limit is split on its next bit, the others stay, until every
bucket fits.  The directory is indexed by the leading bits of the hash, some levels below the expected shards, and names
for each index the shard that holds it; rows look their shard up there.  Indexes whose bytes alone exceed the limit lead
to a further directory of more bits, which only their rows use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridframe.llm import common

#: Bits of the key's hash; bits of a row's own hash follow, so that rows of one key can be split too.
KEY_BITS = 60
#: Bits of the first directory below the expected shards, and bits more of each further one.
BELOW, DEEPER = 4, 12
RESULTS = ("bytes", "shard", "depth", "entry", "shard_bytes", "shard_rows")


def key_bits(*keys: str) -> Column:
    """The first 60 bits of the keys' MD5 as a string of 0 and 1."""
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    return F.lpad(F.conv(F.substring(F.md5(text.cast("binary")), 1, KEY_BITS // 4), 16, 2), KEY_BITS, "0")


def directory(cells: DataFrame, low: int, depth: int, limit: int) -> DataFrame:
    """entry, d, shard, shard_bytes and shard_rows of cells(entry, b, n): for each index of `depth` bits the first bucket, from `low` bits on, that fits.

    A bucket that is too large is split on its next bit; an index without a bucket that fits gets no row.
    """
    up = cells.select("entry", "b", "n", F.explode(F.sequence(F.lit(low), F.lit(depth))).alias("d")).withColumn("shard", F.expr("substring(entry, 1, d)"))
    buckets = up.groupBy("d", "shard").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows")).filter((F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1))
    first = F.min(F.struct("d", "shard", "shard_bytes", "shard_rows")).alias("f")
    return up.select("entry", "d", "shard").join(buckets, ["d", "shard"]).groupBy("entry").agg(first).select("entry", "f.*")


def sharded(rows: DataFrame, keys: list[str], size: Column, limit: int) -> DataFrame:
    """rows(..) with bytes, shard (its bits), depth, entry (the index of the directory that named it), shard_bytes and shard_rows.

    A row's bytes are `size` (null: 0).  Every shard holds at most `limit` bytes or one row.  Repeated rows count and
    go where their hashes send them; a null key is a key like any other; an empty table gives no rows.  Columns of rows
    that have the name of a result give way to it.
    """
    columns = [c for c in rows.columns if c.lower() not in RESULTS]
    weight, bits = (common.field_name(rows, x) for x in ("_bytes", "_bits"))
    own = F.lpad(F.bin(F.xxhash64(F.monotonically_increasing_id())), 64, "0")
    base = common.stored(rows.select(*columns, F.coalesce(size, F.lit(0)).cast("long").alias(weight), F.concat(key_bits(*keys), own).alias(bits)), "shard-rows")
    total = base.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    low, depth = 0, max(0, (max(1, -(-total // limit)) - 1).bit_length()) + BELOW
    active, done = base, None
    while True:
        cells = active.groupBy(F.substring(bits, 1, depth).alias("entry")).agg(F.sum(weight).alias("b"), F.count(F.lit(1)).alias("n"))
        cells = common.stored(cells, "shard-cells")
        names = common.stored(directory(cells, low, depth, limit), "shard-directory")
        last = depth >= KEY_BITS + 64
        found = active.withColumn("entry", F.substring(bits, 1, depth))
        settled = found.join(names, "entry", "left" if last else "inner")
        settled = settled.select(*columns, F.col(weight).alias("bytes"), F.coalesce("shard", "entry").alias("shard"), F.coalesce("d", F.lit(depth)).alias("depth"), "entry", "shard_bytes", "shard_rows")
        done = settled if done is None else done.unionByName(settled)
        if last or not cells.join(names, "entry", "left_anti").limit(1).count():
            return done
        active = common.stored(found.join(names, "entry", "left_anti").select(*columns, weight, bits), "shard-rest")
        low, depth = depth + 1, min(depth + DEEPER, KEY_BITS + 64)
