"""Embedding near-duplicates by randomised-rotation binary codes.

A vector's code is the signs of its randomly rotated unit vector, packed into bits and stored with a correction factor,
the code's inner product with the vector itself.  The other side of a comparison is rotated alike and rounded at random
to LEVELS bits a coordinate, kept as bit planes.  Counting the bits that a code shares with the planes and dividing by
the factor estimates the cosine without bias and within a known error, so only vectors in a pair whose confidence bound
reaches the threshold are fetched, and those pairs computed exactly, in double precision.  Pairs come from buckets of
equal runs of code bits.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm import common
from gridframe.llm.bagminhash import _whole_groups

COSINE = 0.98
#: Runs of BITS code bits; two vectors at cosine 0.98 share none of them in 4 of 100,000 cases.
BANDS, BITS = 24, 16
#: Bits of codes at least, bits of a rounded coordinate, and the standard deviations of the error bound.
CODE_BITS, LEVELS, DEVIATIONS = 128, 4, 5.5
BLOCK = 512
SEED = 20_240_501
_BUCKET = ["label", "dim", "band", "key"]


def codes_of(dim: int) -> int:
    """Rotations whose signs make the code."""
    return max(1, CODE_BITS // dim)


@functools.lru_cache(maxsize=8)
def rotations(dim: int) -> np.ndarray:
    """dim x (dim * k): k random rotations side by side, enough for all runs and codes."""
    k = max(codes_of(dim), -(-BANDS * BITS // dim))
    rng = np.random.default_rng(SEED + dim)
    parts = []
    for _ in range(k):
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        parts.append(q * np.sign(np.diag(r)))
    return np.concatenate(parts, axis=1)


def _packed(bits: np.ndarray) -> np.ndarray:
    """Bits along the last axis as 64-bit words."""
    short = -bits.shape[-1] % 64
    wide = np.concatenate([bits, np.zeros((*bits.shape[:-1], short), bits.dtype)], axis=-1)
    return np.packbits(wide, axis=-1, bitorder="little").view(np.uint64)


def units(vectors: list) -> np.ndarray:
    """Unit vectors in double precision, safe from overflow."""
    v = np.stack(vectors).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def codes(unit: np.ndarray, seed: int = 0) -> dict[str, np.ndarray]:
    """Of unit vectors: keys (n x BANDS); code (n x codes x words) and its factor; planes (n x codes x LEVELS x words) with step, low and total of the rounded coordinates."""
    n, dim = unit.shape
    k = codes_of(dim)
    turned = unit @ rotations(dim)
    keys = (turned[:, : BANDS * BITS] > 0).reshape(n, BANDS, BITS) @ (1 << np.arange(BITS))
    own = turned[:, : k * dim].reshape(n, k, dim)
    low = own.min(axis=2, keepdims=True)
    step = np.maximum((own.max(axis=2, keepdims=True) - low) / ((1 << LEVELS) - 1), 1e-300)
    luck = np.random.default_rng([SEED, dim, seed]).random(own.shape)
    whole = np.minimum(np.floor((own - low) / step + luck), (1 << LEVELS) - 1).astype(np.int64)
    planes = np.stack([_packed(((whole >> j) & 1).astype(np.uint8)) for j in range(LEVELS)], axis=2)
    return {
        "keys": keys.astype(np.int32), "code": _packed((own > 0).astype(np.uint8)), "planes": planes, "factor": np.abs(own).sum(axis=2) / np.sqrt(dim), "step": step[..., 0], "low": low[..., 0],
        "total": low[..., 0] * dim + step[..., 0] * whole.sum(axis=2),
    }


def estimate(a: dict[str, np.ndarray], b: dict[str, np.ndarray], dim: int, least: float = COSINE) -> tuple[np.ndarray, np.ndarray]:
    """Unbiased cosine estimates of coded vectors a against rounded ones b, row by row, and error bounds for pairs of cosine `least` or more.

    The inner product of signs and rounded coordinates is twice the sum over the code's set bits less the total: counts
    of the bits shared with the planes.  The code errs by what of b is at right angles to a, the rounding by half a step.
    """
    ones = np.bitwise_count(a["code"]).sum(axis=2, dtype=np.int64)
    shared = np.bitwise_count(a["code"][:, :, None, :] & b["planes"]).sum(axis=3, dtype=np.int64) @ (1 << np.arange(LEVELS))
    inner = (2 * (b["low"] * ones + b["step"] * shared) - b["total"]) / np.sqrt(dim)
    across = np.sqrt(np.maximum(1 - a["factor"] ** 2, 0) * max(1 - least**2, 0) / max(dim - 1, 1))
    spread = (across**2 + (b["step"] / 2) ** 2) / a["factor"] ** 2
    return (inner / a["factor"]).mean(axis=1), DEVIATIONS * np.sqrt(spread.sum(axis=1)) / spread.shape[1]


_CODED = "keys binary, code binary, planes binary, terms binary"
_TERMS = ("factor", "step", "low", "total")


def _code(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for dim, g in f.groupby(f["embedding"].map(len)):
            c = codes(units(g["embedding"].to_list()), int(g["uid"].iloc[0]) & 0xFFFFFFFF)
            terms = np.stack([c[x] for x in _TERMS], axis=1)
            row = {name: [x.tobytes() for x in np.ascontiguousarray(v)] for name, v in (("keys", c["keys"]), ("code", c["code"]), ("planes", c["planes"]), ("terms", terms))}
            yield g.assign(dim=int(dim), bands=list(c["keys"]), **row)


def _uncoded(f: pd.DataFrame, dim: int) -> dict[str, np.ndarray]:
    n, k = len(f), codes_of(dim)
    flat = lambda name, kind: np.frombuffer(b"".join(f[name]), kind).reshape(n, -1)
    terms = flat("terms", np.float64).reshape(n, len(_TERMS), k)
    code = flat("code", np.uint64).reshape(n, k, -1)
    return {"keys": flat("keys", np.int32), "code": code, "planes": flat("planes", np.uint64).reshape(n, k, LEVELS, -1)} | {x: terms[:, i] for i, x in enumerate(_TERMS)}


def _likely(f: pd.DataFrame, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of one group of f, a bucket's block pair, as pairs whose confidence bound reaches the threshold, in their first shared bucket."""
    c = _uncoded(f, dim)
    group, block, band = (f[x].to_numpy() for x in ("group", "b", "band"))
    straddles = (f["i"] != f["j"]).to_numpy()
    before = np.arange(BANDS)[None, :] < band[:, None]
    for k in range(1, len(f)):
        a = np.flatnonzero(group[:-k] == group[k:])
        if not len(a):
            break
        a = a[~straddles[a] | (block[a] != block[a + k])]
        a = a[~((c["keys"][a] == c["keys"][a + k]) & before[a]).any(axis=1)]
        if len(a):
            one, other = ({x: v[at] for x, v in c.items()} for at in (a, a + k))
            likely, error = estimate(one, other, dim)
            a = a[likely + error >= COSINE]
        if len(a):
            yield a, a + k


def _undecided(frames):
    """Rows sorted by bucket and block pair -> those that are in a pair which has to be computed exactly."""
    for frame in _whole_groups(frames, [*_BUCKET, "i", "j"]):
        for dim, f in frame.groupby("dim"):
            f, met = f.reset_index(drop=True), np.zeros(len(f), bool)
            for a, b in _likely(f, int(dim)):
                met[a] = met[b] = True
            yield f.loc[met, [*_BUCKET, "i", "j", "b", "uid"]]


def _links(frames):
    """Rows sorted by bucket and block pair -> (u, null, links of u) and (u, v, 0), a forest of the links."""
    for frame in _whole_groups(frames, [*_BUCKET, "i", "j"]):
        for dim, f in frame.groupby("dim"):
            yield _linked(f.reset_index(drop=True), int(dim))


def _linked(f: pd.DataFrame, dim: int) -> pd.DataFrame:
    unit, uid, mult = units(f["embedding"].to_list()), f["uid"].to_numpy(), f["mult"].to_numpy()
    counts, left, right = np.zeros(len(f), np.int64), [], []
    for a, b in _likely(f, dim):
        near = (unit[a] * unit[b]).sum(axis=1) >= COSINE
        a, b = a[near], b[near]
        np.add.at(counts, a, mult[b])
        np.add.at(counts, b, mult[a])
        left.append(a)
        right.append(b)
    root = np.arange(len(f))
    if left:
        x, y = np.concatenate(left), np.concatenate(right)
        while True:
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            np.minimum.at(new, root, new)
            new = new[new]
            if (new == root).all():
                break
            root = new
    some, child = np.flatnonzero(counts), np.flatnonzero(root != np.arange(len(f)))
    return pd.DataFrame({"u": np.concatenate([uid[some], uid[child]]), "v": pd.array(np.concatenate([np.zeros(len(some), np.int64), uid[root[child]]]), dtype="Int64"), "n": np.concatenate([counts[some], np.zeros(len(child), np.int64)])})


def classes(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of vectors(vec_id, embedding, label).

    Rows link if their labels are equal and not null and their cosine is COSINE or more.  Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing, nor do vectors of different lengths.  A row without a
    vec_id is a component of its own or takes the smallest vec_id that it reaches; an empty table gives no rows.  Equal vectors
    are collapsed first and counted by multiplicity; buckets are cut into blocks, whose pairs are computed apart, so
    that none is too large for a task and no link is lost.
    """
    e = F.col("embedding")
    sound = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    valid = F.coalesce(F.col("label").isNotNull() & e.isNotNull() & sound, F.lit(False))
    own = F.when(valid, F.md5(F.concat_ws("|", F.col("label").cast("string"), e.cast("string")).cast("binary")))
    base = common.stored(vectors.select("vec_id", "embedding", "label", own.alias("same"), F.monotonically_increasing_id().alias("uid")), "vectors")
    groups = base.filter("same is not null").groupBy("same").agg(F.min("uid").alias("uid"), F.count(F.lit(1)).alias("mult"), F.min("vec_id").alias("low"))
    reps = common.stored(groups, "vector-reps")
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    chosen = base.join(reps.select("uid", "mult"), "uid").select("uid", F.col("label").cast("long").alias("label"), F.col("embedding").cast(kind).alias("embedding"), "mult")
    coded = common.stored(chosen.mapInPandas(_code, f"uid long, label long, embedding {kind}, mult long, dim int, bands array<int>, {_CODED}"), "vector-codes")

    banded = coded.select("uid", "label", "dim", F.posexplode("bands").alias("band", "key"))
    shared = common.stored(banded.groupBy(*_BUCKET).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "vector-buckets")
    blocks = F.ceil(F.col("n") / BLOCK)
    members = (
        common.spread(banded, shared, _BUCKET, "n")
        .withColumn("b", F.pmod(F.xxhash64("uid"), blocks))
        .withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .select(*_BUCKET, F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "uid")
        .join(coded.select("uid", "keys", "code", "planes", "terms"), "uid")
    )
    place = [*_BUCKET, "i", "j"]
    laid = members.repartition(*place).sortWithinPartitions(*place, "uid")
    some = common.stored(laid.mapInPandas(_undecided, "label long, dim int, band int, key int, i long, j long, b long, uid long"), "vector-undecided")
    fetched = some.join(coded.select("uid", "embedding", "mult", "keys", "code", "planes", "terms"), "uid")
    again = fetched.repartition(*place).sortWithinPartitions(*place, "uid")
    links = common.stored(again.mapInPandas(_links, "u long, v long, n long"), "vector-links")
    counts = links.filter("n > 0").groupBy("u").agg(F.sum("n").alias("n"))
    roots = common.stored(common.components(links.filter("n = 0").select("u", "v")), "vector-roots")
    placed = reps.join(counts.withColumnRenamed("u", "uid"), "uid", "left").join(roots.withColumnRenamed("node", "uid"), "uid", "left")
    placed = common.stored(placed.select("same", "low", "mult", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "uid").alias("root")), "vector-places")
    parts = common.stored(placed.groupBy("root").agg(F.min("low").alias("component"), F.count(F.lit(1)).alias("members")), "vector-components")
    named = common.stored(common.spread(placed, parts, ["root"], "members").select("same", "mult", "n_links", "component"), "vector-names")
    rows = base.select("vec_id", "same")
    told = common.spread(rows.filter("same is not null"), named, ["same"], "mult").select("vec_id", "n_links", "component")
    told = told.unionByName(rows.filter("same is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("long").alias("component")))
    alone = F.col("component").isNull()
    return told.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("component")).alias("component_id"),
        F.coalesce(alone | (F.col("vec_id") == F.col("component")), F.lit(False)).alias("kept"),
    )
