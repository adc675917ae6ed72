"""MinHash near-dedup with weighted signatures of word-shingle multisets.

A shingle that occurs c times owns Poisson processes over the integer levels 1..c of its weight.  The levels form dyadic
intervals, each with one process of the interval's whole rate, whose points are thinned to the levels below c, so
that a count of thousands costs a handful of processes.  A point draws a register and a time; a register keeps its
earliest time.  Two registers are equal with the weighted Jaccard similarity as probability.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm import common, textkit

BANDS, ROWS = 32, 6
REGISTERS = BANDS * ROWS
SIMILARITY = 0.8
#: Registers of the longer signatures that rule out pairs of large buckets before their texts are compared.
LONGER = 1024
#: Members that a pivot is compared with in one group, and rows of a block of a bucket.
GROUP, BLOCK = 64, 1024


def least_estimate(m: int) -> float:
    """Signatures of m registers of a pair with SIMILARITY agree on this share at least (five standard deviations)."""
    return SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / m) ** 0.5


_U = np.uint64


def signature(values: np.ndarray, counts: np.ndarray, m: int = REGISTERS) -> np.ndarray:
    """The m earliest times of a bag with at least one element."""
    limit = (np.log(m) + 4) * m / counts.sum()
    while True:
        times = np.full(m, np.inf)
        low, rate, level = 0, 1, 0
        while (rows := np.flatnonzero(counts > low)).size:
            keys = textkit.mix(values[rows] + textkit.wrapped(level + 1, textkit._BASE))
            _points(keys, counts[rows], low, rate, limit, times)
            low, rate, level = low + rate, low + rate, level + 1
        if np.isfinite(times).all():
            return times
        limit *= 2


def _points(keys: np.ndarray, counts: np.ndarray, low: int, rate: int, limit: float, times: np.ndarray) -> None:
    """All points up to `limit` of the processes over levels low+1..low+rate; earlier points go into `times`."""
    last, done, m = np.zeros(len(keys)), 0, len(times)
    step = 1 if rate * limit < 1 else int(rate * limit) + 2
    while len(keys):
        step = max(1, min(step, 2_000_000 // len(keys)))
        draw = textkit.mix(keys[:, None] + np.arange(done + 1, done + step + 1, dtype=np.uint64) * textkit._GOLD)
        gaps = -np.log(((draw >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        at = last[:, None] + np.cumsum(gaps, axis=1)
        row, col = np.nonzero(at <= limit)
        if len(row):
            other = textkit.mix(draw[row, col] ^ _U(0x5851F42D4C957F2D))
            keep = slice(None)
            if rate > 1:
                keep = low + (other >> _U(32)).astype(np.int64) % rate < counts[row]
            np.minimum.at(times, ((other & _U(0xFFFFFFFF)) % _U(m)).astype(np.int64)[keep], at[row, col][keep])
        on = at[:, -1] <= limit
        keys, counts, last, done = keys[on], counts[on], at[on, -1], done + step


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, doc_id, text -> uid, doc_id, digest of the words and band keys (both null without words)."""
    odd = textkit.mix(np.arange(1, ROWS + 1, dtype=np.uint64)) | _U(1)
    band = textkit.mix(np.arange(1, BANDS + 1, dtype=np.uint64) * textkit._GOLD)
    for batch in batches:
        digests, keys = [], []
        for text in batch.column(2):
            words = textkit.word_hashes(text.as_py())
            if not len(words):
                digests.append(None), keys.append(None)
                continue
            digests.append(hashlib.blake2b(words.tobytes(), digest_size=16).digest())
            drawn = textkit.mix(signature(*np.unique(textkit.shingle_hashes(words), return_counts=True)).view(np.uint64))
            keys.append(textkit.mix((drawn.reshape(BANDS, ROWS) * odd).sum(axis=1, dtype=np.uint64) + band).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["uid", "doc_id", "digest", "bands"])


def _longer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """uid, text -> uid and one byte a register of the longer signature."""
    for batch in batches:
        drawn = [textkit.mix(signature(*textkit.bag(t.as_py()), LONGER).view(np.uint64)) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([(d & _U(255)).astype(np.uint8).tobytes() for d in drawn], pa.binary())], ["uid", "bytes"])


def _verify(frames):
    """Rows sorted by pivot, salt and role (the pivot itself first) -> linked pairs."""
    import pandas as pd

    pivot, mine = None, None
    for frame in frames:
        out = []
        for p, s, role, x, text in zip(frame["p"], frame["s"], frame["role"], frame["x"], frame["text"]):
            if role == 0:
                pivot, mine = (p, s), textkit.bag(text)
            elif pivot == (p, s) and textkit.overlap(mine, textkit.bag(text)) >= SIMILARITY:
                out.append((x, p))
        yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs(p, x) (stored) whose multisets overlap enough, as edges(u, v).

    A pivot's members are dealt out in groups of about GROUP; each group gets the pivot's text once, each member's
    text once a pair.  A pivot's text is copied to its groups in two steps, each of at most GROUP**2 copies a row.
    """
    sizes = common.stored(pairs.groupBy("p").agg(F.count(F.lit(1)).alias("n")), "pivots")
    groups = F.ceil(F.col("n") / GROUP)
    dealt = common.spread(pairs, sizes, ["p"], "n").select("p", "x", F.pmod(F.xxhash64("x"), groups).alias("s"))
    one = texts.select(F.col("uid").alias("x"), "text")
    members = dealt.join(one, "x").select("p", "s", F.lit(1).alias("role"), "x", "text")
    many = GROUP * GROUP
    pivots = sizes.withColumn("x", F.col("p")).join(one, "x").withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((groups - 1) / many))))
    within = F.sequence(F.col("lot") * many, F.least(groups, (F.col("lot") + 1) * many) - 1)
    heads = pivots.repartition("p", "lot").select("p", F.explode(within).alias("s"), F.lit(0).alias("role"), "x", "text")
    laid = members.unionByName(heads).repartition("p", "s").sortWithinPartitions("p", "s", "role", "x")
    return laid.mapInPandas(_verify, "u long, v long")


def _cross_pairs(frames):
    """Members of buckets, sorted by bucket and block pair -> pairs of unlike components that may be similar."""
    import pandas as pd

    for frame in _whole_groups(frames, ["band", "key", "i", "j"]):
        code = np.frombuffer(b"".join(frame["bytes"]), np.uint8).reshape(len(frame), LONGER)
        short = np.ascontiguousarray(code[:, :REGISTERS])
        group, uid, root, block, pivot, band = (frame[c].to_numpy() for c in ("group", "uid", "root", "b", "p", "band"))
        keys, earlier = np.stack(frame["bands"].to_numpy()), np.arange(BANDS)[None, :] < band[:, None]
        straddles = (frame["i"] != frame["j"]).to_numpy()
        for k in range(1, len(frame)):
            a = np.flatnonzero(group[:-k] == group[k:])
            if not len(a):
                break
            b = a + k
            ok = (root[a] != root[b]) & (uid[a] != pivot[a]) & (uid[b] != pivot[b]) & (~straddles[a] | (block[a] != block[b]))
            a, b = a[ok], b[ok]
            for at in range(0, len(a), 65536):
                x, y = a[at : at + 65536], b[at : at + 65536]
                first = ~((keys[x] == keys[y]) & earlier[x]).any(axis=1)  # a pair counts in the first bucket that it shares
                x, y = x[first], y[first]
                near = (short[x] == short[y]).sum(axis=1) >= least_estimate(REGISTERS) * REGISTERS
                x, y = x[near], y[near]
                near = (code[x] == code[y]).sum(axis=1) >= least_estimate(LONGER) * LONGER
                if near.any():
                    u, v = uid[x[near]], uid[y[near]]
                    yield pd.DataFrame({"p": np.minimum(u, v), "x": np.maximum(u, v)})


def _whole_groups(frames, keys: list[str]):
    """Joins and cuts frames at group borders and numbers the groups in column `group`; rows come sorted by keys."""
    import pandas as pd

    rest = None
    for frame in frames:
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        turn = np.zeros(len(frame), bool)
        for k in keys:
            v = frame[k].to_numpy()
            turn[1:] |= v[1:] != v[:-1]
        frame["group"] = np.cumsum(turn)
        last = int(np.flatnonzero(turn)[-1]) if turn.any() else 0
        rest = frame.iloc[last:].drop(columns="group")
        if last:
            yield frame.iloc[:last].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest.assign(group=0).reset_index(drop=True)


def classes(docs: DataFrame) -> DataFrame:
    """Near-duplicate classes of docs(doc_id, text): uid, doc_id, class_id, class_size, kept; a row for each row.

    A class is a connected component of texts whose five-word shingle multisets overlap by SIMILARITY or more;
    class_id is its smallest doc_id, and the first row with it is kept.  Texts without words (null, empty, punctuation)
    form classes of their own; a null doc_id sorts last.  Equal word sequences are joined by digest.  A bucket's
    members meet its most connected member first; where that leaves several components, the pairs between components that
    the signatures don't rule out are compared too, in blocks, so that no link is lost to a bucket's size.  An empty
    table gives no rows; further columns are passed over.
    """
    rows = common.with_row_id(common.steady(docs).select("doc_id", "text"), "uid")
    drawn = rows.select("uid", F.col("doc_id").cast("long"), "text").mapInArrow(_sketches, "uid long, doc_id long, digest binary, bands array<long>")
    base = common.stored(drawn, "sketches")
    wordy = base.filter("digest is not null")
    reps = common.stored(wordy.groupBy("digest").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("same")), "reps")
    heads = common.stored(wordy.join(reps, ["digest", "uid"], "left_semi").select("uid", "bands"), "heads")
    banded = heads.select("uid", F.posexplode("bands").alias("band", "key"))
    bucket = ["band", "key"]
    shared = common.stored(banded.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    met = common.stored(common.spread(banded, shared, bucket, "n"), "met")
    # the text that others were copied from shares the most buckets with them
    fame = met.groupBy("uid").agg(F.sum("n").alias("fame"))
    best = F.max(F.struct("fame", (-F.col("uid")).alias("back"))).alias("f")
    pivots = common.stored(met.join(fame, "uid").groupBy(*bucket, "n").agg(best).select(*bucket, "n", (-F.col("f.back")).alias("p")), "bucket-pivots")
    members = common.stored(common.spread(met.drop("n"), pivots, bucket, "n"), "members")
    stars = common.stored(members.filter("uid <> p").select("p", F.col("uid").alias("x")).distinct(), "stars")
    wanted = members.select("uid").distinct()
    texts = common.stored(rows.select("uid", "text").join(wanted.hint("shuffle_hash"), "uid"), "texts")
    links = common.stored(verified(stars, texts), "links")
    roots = common.stored(common.components(links), "roots")

    rooted = members.filter("n > 2").join(roots.withColumnRenamed("node", "uid"), "uid", "left").withColumn("root", F.coalesce("root", "uid"))
    rooted = common.stored(rooted, "rooted")
    split = rooted.groupBy(*bucket, "n").agg(F.min("root").alias("a"), F.max("root").alias("z")).filter("a < z").select(*bucket, "n")
    unsettled = common.stored(common.spread(rooted.drop("n"), common.stored(split, "split"), bucket, "n"), "unsettled")
    longer = common.stored(texts.join(unsettled.select("uid").distinct(), "uid", "left_semi").select("uid", "text").mapInArrow(_longer, "uid long, bytes binary"), "longer")
    blocks = F.ceil(F.col("n") / BLOCK)
    open_ = (
        unsettled.withColumn("b", F.pmod(F.xxhash64("uid"), blocks))
        .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .join(longer, "uid")
        .join(heads, "uid")
        .select("band", "key", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "uid", "root", "b", "p", "bytes", "bands")
    )
    cross = open_.repartition("band", "key", "i", "j").sortWithinPartitions("band", "key", "i", "j").mapInPandas(_cross_pairs, "p long, x long").distinct()
    more = verified(common.stored(cross, "cross"), texts)
    edges = common.stored(links.unionByName(more), "edges")
    roots = common.stored(common.components(edges), "roots")

    of_digest = reps.join(roots.withColumnRenamed("node", "uid"), "uid", "left").select("digest", F.coalesce("root", "uid").alias("root"), "same")
    told = common.spread(wordy.select("uid", "doc_id", "digest"), common.stored(of_digest, "digest-roots"), ["digest"], "same").select("uid", "doc_id", "root")
    placed = common.stored(told.unionByName(base.filter("digest is null").select("uid", "doc_id", F.col("uid").alias("root"))), "placed")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("uid").alias("uid")))
    named = common.stored(placed.groupBy("root").agg(first.alias("f"), F.count(F.lit(1)).alias("class_size")), "classes")
    return common.spread(placed, named, ["root"], "class_size").select("uid", "doc_id", F.col("f.id").alias("class_id"), "class_size", (F.col("uid") == F.col("f.uid")).alias("kept"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that their classes keep, with all columns."""
    docs = common.steady(docs)
    uid = common.field_name(docs, "uid")
    kept = classes(docs).filter("kept").select(F.col("uid").alias(uid))
    return common.with_row_id(docs, uid).join(kept.hint("shuffle_hash"), uid, "left_semi").drop(uid)
