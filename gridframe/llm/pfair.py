"""Mixing sources to target weights by Pfair scheduling.

A source of weight w gives its i-th block the release time floor(i / w) and the deadline ceil((i + 1) / w); in each slot the
released block with the earliest deadline goes next.  One slot holds one block, the weights sum to 1, so every block meets
its window and a source's share never differs by a block or more from its weight times the slots.  Windows
are exact, in whole numbers, and the driver simulates every slot, a block of rows each.  When a source is used up, the
others go on with their weights scaled up.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.llm import common

#: Rows of a block; of more rows than the driver can schedule so, blocks are larger, at most MOST_BLOCKS in all.
BLOCK_ROWS, MOST_BLOCKS = 32, 1 << 24
#: Blocks that the driver holds at once, and up to which their table is broadcast.
HELD, BROADCAST = 500_000, 40_000
#: Sources whose counts the driver takes in; weights are a dict, so this is far above any real mixture.
MOST_SOURCES = 100_000


#: The columns that a schedule adds; columns of these names in the rows give way to them.
RESULTS = ("target", "block", "release", "deadline", "slot", "position")


def quotas(weights: dict, period: int) -> dict:
    """Blocks a period for each source: at least 1, in proportion to its weight by largest remainders."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    out = {s: max(1, math.floor(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (out[s] - exact[s], str(s)))
    short = period - sum(out.values())
    for i in range(abs(short)):
        s = order[i % len(order)] if short > 0 else max(out, key=lambda s: (out[s], str(s)))
        out[s] += 1 if short > 0 else -1
    return out


def windows(i: int, quota: int, period: int) -> tuple[int, int]:
    """Release time and deadline of a source's i-th block of a period."""
    return i * period // quota, -(-(i + 1) * period // quota)


def earliest(quota: list[int], period: int) -> Iterator[tuple[int, int, int, int]]:
    """Slot by slot the source, its block's number, release time and deadline, by earliest deadline among the released blocks."""
    coming, ready, done, t = [(0, k) for k in range(len(quota))], [], [0] * len(quota), 0
    while True:
        while coming and coming[0][0] <= t:
            release, k = heapq.heappop(coming)
            heapq.heappush(ready, (windows(done[k], quota[k], period)[1], k, release))
        deadline, k, release = heapq.heappop(ready)
        yield k, done[k], release, deadline
        done[k] += 1
        heapq.heappush(coming, (windows(done[k], quota[k], period)[0], k))
        t += 1


def timetable(quota: dict, period: int) -> list:
    """The source of each slot of a period."""
    names = sorted(quota, key=str)
    return [names[k] for k, *_ in islice(earliest([quota[s] for s in names], period), period)]


def placed(blocks: dict, weights: dict) -> Iterator[tuple]:
    """Source, block, target, release, deadline and slot of every block.  A phase ends when the next source is used up."""
    used, start = dict.fromkeys(blocks, 0), 0
    while left := sorted((s for s, n in blocks.items() if used[s] < n), key=str):
        total = sum(weights[s] for s in left)
        exact = [Fraction(weights[s]) for s in left]
        common_part = math.lcm(*(x.denominator for x in exact))
        quota = [int(x * common_part) for x in exact]
        first, slot = dict(used), start
        for k, i, release, deadline in earliest(quota, sum(quota)):
            s = left[k]
            if used[s] == blocks[s]:
                break
            yield s, first[s] + i, weights[s] / total, start + release, min(start + deadline, (1 << 63) - 1), slot
            used[s] += 1
            slot += 1
        start = slot


def timetables(spark: SparkSession, blocks: dict, weights: dict) -> DataFrame:
    """placed() as a table; of many blocks the driver holds a part at a time."""
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64()]
    names = ["_s", "_block", "target", "release", "deadline", "slot"]
    rows, out = placed(blocks, weights), None
    while (part := list(islice(rows, HELD))) or out is None:
        columns = list(zip(*part)) or [[]] * len(names)
        table = spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names))
        if out is not None or len(part) == HELD:
            table = common.stored(table, "timetable")
        out = table if out is None else out.unionByName(table)
    return F.broadcast(out) if sum(blocks.values()) <= BROADCAST else out


def scheduled(rows: DataFrame, source: str, key: str, weights: dict | None = None, block_rows: int | None = None) -> DataFrame:
    """rows and where each goes: target, block, release, deadline, slot and position (unique; the order of the mixture).

    target is the weight asked for, over the sum of the weights of the sources not yet used up.
    rows has to be stored.  `key` is a unique column; its hash orders the rows of a source.  A null source is a source
    like any other.  Without weights a source's target is the square root of its rows.  Every row is kept.
    """
    spark = rows.sparkSession
    counts = {r[0]: r[1] for r in rows.groupBy(source).count().limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    block_rows = block_rows or max(BLOCK_ROWS, -(-sum(counts.values()) // MOST_BLOCKS))
    if weights is None:
        weights = {s: math.sqrt(n) for s, n in counts.items()}
    if missing := [s for s in counts if not weights.get(s, 0) > 0]:
        raise ValueError(f"no positive weight for {missing[:5]}")
    known = timetables(spark, {s: -(-n // block_rows) for s, n in counts.items()}, weights)
    h = F.xxhash64(key)
    chunk = F.shiftrightunsigned(h, 64 - (common.CHUNKS - 1).bit_length())
    rank, block = (common.field_name(rows, x) for x in ("_rank", "_block"))
    numbered = common.ranked(rows, [source], chunk, [h, F.col(key)], rank).withColumn(block, F.floor(F.col(rank) / block_rows))
    own = [c for c in rows.columns if c.lower() not in RESULTS]
    joined = numbered.alias("l").join(known.alias("k"), F.col(f"l.`{source}`").eqNullSafe(F.col("k._s")) & (F.col(f"l.`{block}`") == F.col("k._block")))
    position = (F.col("k.slot") * block_rows + F.pmod(F.col(f"l.`{rank}`"), F.lit(block_rows))).cast("long").alias("position")
    return joined.select(*[F.col(f"l.`{c}`") for c in own], "k.target", F.col("k._block").alias("block"), "k.release", "k.deadline", "k.slot", position)


def mixed(docs: DataFrame, source: str = "source", weights: dict | None = None, block_rows: int | None = None) -> DataFrame:
    """All rows of docs in the order of the mixture, range-partitioned by it: written files hold it in file and row order.

    A null source, or none in docs, is a source like any other; repeated rows keep their number; an empty table stays empty.
    """
    docs = common.steady(docs)
    uid, at = common.field_name(docs, "uid"), common.field_name(docs, "position")
    whole = common.with_row_id(docs, uid)
    keys = common.stored(whole.select(F.col(uid).alias("uid"), (F.col(source).cast("string") if source in docs.columns else F.lit(None).cast("string")).alias("source")), "mix")
    placed = scheduled(keys, "source", "uid", weights, block_rows).select(F.col("uid").alias(uid), F.col("position").alias(at))
    joined = whole.join(placed.hint("shuffle_hash"), uid)
    return joined.repartitionByRange(at).sortWithinPartitions(at).drop(uid, at)
