"""Best-fit packing of documents into sequences of a fixed number of tokens.

The pieces' length histogram (a row for each length up to the sequence length) goes to the driver; a configuration linear
program over it is solved by multiplicative weights, whose pricing step is a knapsack by dynamic programming.  The
fractional solution is rounded down and the lengths that are left are filled best-fit, on counts alone.  The pieces
then find their places from their number within their length, in the order of the input: the patterns take turns along
it, and sequences are numbered by their first piece's position.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm import common, tokens

CAPACITY, END = 1024, 2
#: Pricing rounds of the linear program and their step.
ROUNDS, EPSILON = 600, 0.2
#: Turns that each pattern takes along the input.
TURNS = 64

PIECES = "doc_id long, part string, at long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of docs(doc_id, text): each document's ids and then `end`, cut if longer than a sequence.

    The first piece of a cut document takes what the others, all of full length, leave.  A null or empty text is one
    piece, the end id alone.  part and at say where the row is, its file and row.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        for batch in batches:
            out = [[] for _ in range(7)]
            for doc, part, row, text in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                ids = np.append(encode.ids(text.as_py()), np.uint32(end)).astype("<u4")
                at, k = 0, 0
                length = len(ids) % capacity or capacity
                while at < len(ids):
                    for to, v in zip(out, (doc, part, row, k, at, length, zlib.crc32(ids[at : at + length].tobytes()))):
                        to.append(v)
                    at, k, length = at + length, k + 1, capacity
            yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(i, pa.int64())) for i, v in enumerate(out)], ["doc_id", "part", "at", "piece", "start", "length", "ids_crc32"])

    kinds = {1: pa.string(), 3: pa.int32()}
    docs = common.steady(docs)
    row = docs.metadataColumn("_metadata")
    return docs.select(F.col("doc_id").cast("long"), row["file_path"].alias("part"), row["row_index"].alias("at"), "text").mapInArrow(cut, PIECES)


def _best_config(lengths: np.ndarray, value: np.ndarray, capacity: int) -> dict[int, int]:
    """Index -> copies of the lengths that fit one sequence with the largest total value (each usable again and again)."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c], last[c] = best[c - 1], -1
        if fits[c]:
            total = best[c - lengths[: fits[c]]] + value[: fits[c]]
            i = int(total.argmax())
            if total[i] > best[c]:
                best[c], last[c] = total[i], i
    config: dict[int, int] = {}
    c = capacity
    while c > 0:
        if (i := int(last[c])) < 0:
            c -= 1
        else:
            config[i] = config.get(i, 0) + 1
            c -= int(lengths[i])
    return config


def fractional(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS) -> tuple[list[tuple[dict[int, int], float]], np.ndarray, float]:
    """Configurations and how often each is taken, how often that covers each row, and a lower bound of the LP's optimum.

    Each round prices a configuration under the rows' weights, takes it until it covers its scarcest row once, and
    lowers the weights of the rows by what they gained.  Divided by the least cover it is a solution of the covering
    program; the bound comes from the weights by duality.  lengths ascend.
    """
    weight, covered = 1.0 / counts, np.zeros(len(lengths))
    taken: dict[tuple, float] = {}
    bound = float((lengths * counts).sum()) / capacity
    for _ in range(rounds):
        best = _best_config(lengths, weight, capacity)
        bound = max(bound, float((weight * counts).sum()) / sum(weight[i] * k for i, k in best.items()))  # weak duality
        config = {i: min(k, int(counts[i])) for i, k in best.items()}
        rows, copies = np.fromiter(config, int), np.fromiter(config.values(), float)
        step = float((counts[rows] / copies).min())
        key = tuple(sorted(config.items()))
        taken[key] = taken.get(key, 0.0) + step
        gain = copies * step / counts[rows]
        covered[rows] += gain
        weight[rows] *= (1 - EPSILON) ** gain
        weight /= weight.max()
    return [(dict(k), x) for k, x in taken.items()], covered, bound


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Patterns (length -> copies) and how many sequences each fills; together they hold every piece exactly once.

    The solution of the linear program is rounded down at two scales, the least and the mean cover, what is left is
    filled best-fit, and the plan with the fewest sequences is taken; it can't beat the dual bound.
    """
    left = {length: n for length, n in histogram.items() if n > 0}
    out = []
    if n := left.pop(capacity, 0):
        out.append(({capacity: 1}, n))
    if not left:
        return out
    lengths = np.array(sorted(left))
    counts = np.array([left[x] for x in lengths.tolist()], float)
    solution, covered, bound = fractional(lengths, counts, capacity)
    scales = [covered[covered > 0].mean(), *([covered.min()] if covered.min() > 0 else [])]
    plans = [_rounded([(c, x / scale) for c, x in solution], lengths, left, capacity) for scale in scales]
    best = min([*plans, _best_fit(dict(left), capacity)], key=lambda p: sum(many for _, many in p))
    assert sum(many for _, many in best) >= bound - 1e-6 * bound, "fewer sequences than the dual bound allows"
    return out + best


def _rounded(solution: list[tuple[dict[int, int], float]], lengths: np.ndarray, histogram: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """A fractional solution rounded down, the fullest configurations first, and the rest best-fit."""
    left, out = dict(histogram), []
    full = lambda c: sum(int(lengths[i]) * k for i, k in c.items())
    for config, x in sorted(solution, key=lambda s: (-full(s[0]), -s[1])):
        many = min([int(x), *(left[int(lengths[i])] // k for i, k in config.items())])
        if many:
            pattern = {int(lengths[i]): k for i, k in config.items()}
            out.append((pattern, many))
            for length, k in pattern.items():
                left[length] -= k * many
    return out + _best_fit({k: n for k, n in left.items() if n}, capacity)


def _best_fit(left: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """Fills sequences from the longest length down, the same pattern as often as the counts allow."""
    import bisect

    out, lengths = [], sorted(left)
    while lengths:
        room, pattern, at = capacity, {}, len(lengths)
        while (at := bisect.bisect_right(lengths, room, 0, at)) > 0:
            length = lengths[at - 1]
            k = min(left[length], room // length)
            pattern[length], room, at = k, room - k * length, at - 1
        many = min(left[x] // k for x, k in pattern.items())
        out.append((pattern, many))
        for x, k in pattern.items():
            left[x] -= k * many
        lengths = [x for x in lengths if left[x]]
    return out


def in_turns(patterns: list[tuple[dict[int, int], int]], turns: int = TURNS) -> list[tuple[dict[int, int], int]]:
    """The same patterns as often, each spread evenly over so many turns."""
    spread = [(pattern, many * (t + 1) // turns - many * t // turns) for t in range(turns) for pattern, many in patterns]
    return [(pattern, many) for pattern, many in spread if many]


def places(patterns: list[tuple[dict[int, int], int]]) -> dict[str, np.ndarray]:
    """By length and rank: where a run of ranks starts, its copies a sequence, its first sequence and offset."""
    rows, sequence, taken = [], 0, {}
    for pattern, many in patterns:
        offset = 0
        for length in sorted(pattern, reverse=True):
            k = pattern[length]
            rows.append((length, taken.get(length, 0), k, sequence, offset))
            taken[length] = taken.get(length, 0) + k * many
            offset += k * length
        sequence += many
    rows.sort()
    return {name: np.array([r[i] for r in rows], np.int64) for i, name in enumerate(("length", "rank", "copies", "sequence", "offset"))}


def packed(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Where each piece of docs(doc_id, text) goes: a row for each piece of each row.

    doc_id, piece, start, length, ids_crc32, sequence_id and offset.  Repeated rows are packed once each; a null
    doc_id stays null; an empty table gives no rows; further columns are passed over.  Sequences follow the order of
    docs, by files and rows if it is stored.
    """
    spark = docs.sparkSession
    cut = common.stored(pieces(docs, path or tokens.default_path(), capacity), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").agg(F.count(F.lit(1))).collect()}  # at most `capacity` rows
    found = places(in_turns(plan(histogram, capacity)))
    starts, rows = [], 0
    for part, n in sorted(cut.groupBy("part").agg(F.max("at") + 1).collect(), key=lambda r: (len(r[0]), r[0])):  # a row a file
        starts.append((part, rows))
        rows += n

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f in batches:
            length, rank = f["length"].to_numpy(), f["rank"].to_numpy()
            # (length, rank) as one ascending number: ranks stay below `span`
            at = np.searchsorted(found["length"] * span + found["rank"], length * span + rank, side="right") - 1
            past = rank - found["rank"][at]
            slot = found["sequence"][at] + past // found["copies"][at]
            offset = found["offset"][at] + past % found["copies"][at] * length
            yield pa.RecordBatch.from_arrays([*(f[c] for c in kept), pa.array(slot, pa.int64()), pa.array(offset, pa.int64())], [*kept, "slot", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32", "position"]
    span = max([1, *histogram.values()]) + 1
    known = F.broadcast(spark.createDataFrame(starts, "part string, _first long"))
    lined = cut.join(known, "part").select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("at")).alias("position"))
    chunk = F.floor(F.col("position") * common.CHUNKS / max(rows, 1))
    numbered = common.ranked(lined, ["length"], chunk, [F.col("position"), F.col("piece")], "rank")
    placed = common.stored(numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, position long, slot long, offset long"), "placed")
    first = common.stored(placed.groupBy("slot").agg(F.min("position").alias("position")), "slots")
    order = common.ranked(first, [], chunk, [F.col("position"), F.col("slot")], "sequence_id").select("slot", "sequence_id")
    return placed.join(order, "slot").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
