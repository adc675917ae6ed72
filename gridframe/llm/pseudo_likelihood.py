"""Masked pseudo-likelihood of documents by a bidirectional window network, trained in numpy.

The network predicts a word from the WINDOW words on each side: their embeddings, a tanh layer, and a two-level softmax
(group of classes, class in the group), which is normalised exactly.  The most frequent words of the whole corpus have a
class of their own, and the classes grow with the corpus; the others share RARE hash classes, and one of them has its
class's probability times its share of the class's occurrences.  Counts of all words are stored: those above a frequency
that grows with the square root of the corpus are held in memory, the rest are joined.  Class ids are stored once; each
round trains on the whole data of every partition, every ROUNDS-th word as target, and averages the parameters by words.

What a window can't tell, that a passage was written elsewhere too, the corpus tells: texts are cut into spans where the
words say so, and a span's probability given the words next to it on both sides mixes the network's (the product over
its words) with the share of the other documents with these neighbours that have this very span, by Witten and Bell's
weights.  Counts of spans are joined, over all documents.  A document's score is the sum of its spans' log-probabilities.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridframe.llm import common, textkit

WINDOW, GROUPS, WIDTH, HIDDEN = 2, 32, 8, 16
CLASSES, RARE = GROUPS * GROUPS, 64
VOCABULARY = CLASSES - RARE
#: Words of a corpus from which the classes grow, and the root of the corpus by which words are held in memory.
GROWS, HELD = 1_000_000, 300
ROUNDS, RATE, BATCH = 4, 0.04, 8192
#: Words of a span on average: a span ends where a hash of its last two words is a multiple.
SPAN = 32
#: Texts that a task works on at once; it holds some hundred bytes for each of their words.
TEXTS = 2000
_U = np.uint64


def _groups(total: float) -> int:
    """Groups of classes, and classes a group, for a corpus of so many words."""
    return max(GROUPS, math.ceil(GROUPS * (total / GROWS) ** 0.125))


def _shapes(groups: int) -> dict[str, tuple]:
    """The last embedding is that of the padding."""
    return {"embed": (groups * groups + 1, WIDTH), "w1": (2 * WINDOW * WIDTH, HIDDEN), "b1": (HIDDEN,), "wg": (HIDDEN, groups), "bg": (groups,), "wc": (groups, HIDDEN, groups), "bc": (groups, groups)}


def _unique(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [textkit.word_hashes(t.as_py()) for t in batch.column(0)]
        word, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *words]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])


def counted(docs: DataFrame) -> DataFrame:
    """word and n of all words of all texts, stored."""
    counts = docs.select("text").mapInArrow(_unique, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return common.stored(counts, "words")


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The words held in memory as sorted hashes with their codes, and the occurrences of each code.

    The first groups**2 codes are classes: from VOCABULARY on the RARE shared ones, in which words without a code are
    counted, the others the most frequent words.  Further codes are words of shared classes.
    """
    counts = counted(docs) if counts is None else counts
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = held_from(total)
    held = counts.filter(F.col("n") >= least).toPandas().sort_values(["n", "word"], ascending=[False, True])
    rare = counts.filter(F.col("n") < least).groupBy(F.pmod("word", F.lit(RARE)).alias("r")).agg(F.sum("n").alias("n")).toPandas()  # RARE rows
    code = np.arange(len(held))
    code[VOCABULARY:] += RARE
    size = np.zeros(max(_groups(total) ** 2, len(held) + RARE))
    size[code] = held["n"].to_numpy()
    size[VOCABULARY + rare["r"].to_numpy(dtype=int)] = rare["n"].to_numpy()
    words = held["word"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(words)
    return np.stack([words[order], code[order].astype(np.uint64)]), size


def held_from(total: float) -> int:
    """Occurrences from which a word is held in memory."""
    return max(1, math.ceil(math.sqrt(total) / HELD))


def shared(words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The words with a class of their own, the occurrences of the classes, and the held words of shared classes with their log shares."""
    many = _groups(size.sum()) ** 2
    own = words[1] < many
    rest, n = words[0][~own], size[words[1][~own].astype(np.int64)]
    at = VOCABULARY + (rest & np.uint64(RARE - 1)).astype(np.int64)
    of_class = size[:many].copy()
    np.add.at(of_class, at, n)
    return words[:, own], of_class, rest, np.log(n / of_class[at])


def classes(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The classes of word hashes: of the few known words with a hash's leading 16 bits each is compared with it."""
    out = VOCABULARY + (h.view(np.int64) & (RARE - 1))  # RARE is a power of two
    if not words.shape[1]:
        return out
    if words.shape[1] > 1 << 17:  # buckets of many words
        at = np.minimum(np.searchsorted(words[0], h), words.shape[1] - 1)
        return np.where(words[0][at] == h, words[1][at].astype(np.int64), out)
    first = np.searchsorted(words[0] >> np.uint64(48), np.arange((1 << 16) + 1, dtype=np.uint64)).astype(np.int32)
    most = int(np.diff(first).max())
    key, code = (np.append(x, np.repeat(x[-1:], most)) for x in (words[0], words[1].astype(np.int64)))
    at = first[h >> np.uint64(48)]
    for k in range(most):
        hit = np.flatnonzero(key[at + k] == h)
        out[hit] = code[at[hit] + k]
    return out


def initial(size: np.ndarray, seed: int = 7) -> dict[str, np.ndarray]:
    """Small random weights; the biases are the classes' frequencies in the corpus."""
    size = np.maximum(size, 1)
    groups = math.isqrt(len(size))
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * (0.5 if k == "embed" else 0.2 if k == "w1" else 0.01)).astype(np.float32) for k, s in _shapes(groups).items()}
    table = size.reshape(groups, groups)
    p["bg"] = np.log(table.sum(axis=1) / table.sum()).astype(np.float32)
    p["bc"] = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32)
    p["b1"][:] = 0
    p["embed"][-1] = 0
    return p


def _exp(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The exponentials of logits, in place, and their sums; logits are far from the bounds that keep them finite."""
    np.exp(np.clip(z, -80, 80, out=z), out=z)
    return z, z @ np.ones(z.shape[1], np.float32)  # far faster than a sum over short rows


def step(p: dict[str, np.ndarray], sides: np.ndarray, target: np.ndarray, rate: float = 0.0) -> np.ndarray:
    """Log-probabilities of the targets given their sides; with a rate, one gradient step as well."""
    n, groups = len(target), len(p["bg"])
    order = np.argsort(target, kind="stable")  # a group's targets side by side
    sides, target = sides[order], target[order]
    x = p["embed"][sides].reshape(n, -1)
    h = np.tanh(x @ p["w1"] + p["b1"])
    group, own = target // groups, target % groups
    pg, sums = _exp(h @ p["wg"] + p["bg"])
    edges = np.searchsorted(group, np.arange(groups + 1))
    parts = [(g, slice(edges[g], edges[g + 1])) for g in range(groups) if edges[g] < edges[g + 1]]
    rows, logp = np.arange(n), np.empty(n, np.float32)
    inner = {}
    for g, at in parts:
        z, total = inner[g] = _exp(h[at] @ p["wc"][g] + p["bc"][g])
        logp[at] = z[rows[: len(z)], own[at]] / total
    logp = np.log(logp + 1e-12) + np.log(pg[rows, group] / sums + 1e-12)
    if rate:
        pg /= sums[:, None]
        pg[rows, group] -= 1
        back = pg @ p["wg"].T
        scale = np.float32(rate / n ** 0.5)
        p["wg"] -= scale * (h.T @ pg)
        p["bg"] -= scale * pg.sum(axis=0)
        for g, at in parts:
            d, total = inner[g]
            d /= total[:, None]
            d[rows[: len(d)], own[at]] -= 1
            back[at] += d @ p["wc"][g].T
            p["wc"][g] -= scale * (h[at].T @ d)
            p["bc"][g] -= scale * d.sum(axis=0)
        back *= 1 - h * h
        into = (back @ p["w1"].T).reshape(-1, WIDTH)
        p["w1"] -= scale * (x.T @ back)
        p["b1"] -= scale * back.sum(axis=0)
        flat = sides.ravel()
        for k in range(WIDTH):
            p["embed"][:, k] -= scale * np.bincount(flat, into[:, k], len(p["embed"])).astype(np.float32)
        p["embed"][-1] = 0
        for v in p.values():
            np.clip(v, -20, 20, out=v)
    out = np.empty(n, np.float32)
    out[order] = logp
    return out


def windows(texts: list[np.ndarray], pad: int, first: int = 0, every: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Sides and targets of the words of texts, given as class ids; of every so many words from the first on."""
    n = np.array([len(x) for x in texts], int)
    at = np.arange(n.sum()) + WINDOW * np.repeat(np.arange(1, len(n) + 1), n)
    line = np.full(n.sum() + WINDOW * (len(n) + 1), pad, np.int32)
    line[at] = np.concatenate([np.zeros(0, np.int32), *texts])
    at = at[first::every]
    return np.stack([line[at + k] for k in range(-WINDOW, WINDOW + 1) if k], axis=1) if len(at) else np.zeros((0, 2 * WINDOW), np.int32), line[at]


def _batches(spark: SparkSession):
    """Python tasks get TEXTS rows at once."""
    return common.setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS))


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in p.values()])


def _shaped(flat: np.ndarray, shapes: dict[str, tuple]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes.items():
        n = int(np.prod(s))
        out[k], at = flat[at : at + n].reshape(s).astype(np.float32), at + n
    return out


def _kind(classes: int) -> str:
    """How class ids are stored."""
    return "<u2" if classes <= 1 << 16 else "<u4"


def _ids(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind).astype(np.int32) for x in column]


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of v and n over a task's rows."""
    v, n = None, 0
    for batch in batches:
        for x in batch.column(0):
            one = np.frombuffer(x.as_buffer(), np.float64)
            v = one.copy() if v is None else v + one
        n += sum(batch.column(1).to_pylist())
    if v is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["v", "n"])


def train(coded: DataFrame, start: dict[str, np.ndarray], rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Rounds of local training over all texts of coded(ids) and averaging: a word is a target in one round, in all rounds a context.

    A task sends its parameters as one row; about a root of so many tasks add them up, and the driver adds their sums.
    """
    flat, shapes, pad = _flat(start), _shapes(len(start["bg"])), len(start["embed"]) - 1
    kind = _kind(pad)
    adders = max(1, math.isqrt(len(coded.inputFiles())))
    for k in range(rounds):
        begin, rate = flat.copy(), RATE / (1 + k) ** 0.5

        def local(batches, begin=begin, rate=rate, k=k):
            p, seen = _shaped(begin, shapes), 0
            for batch in batches:
                sides, target = windows(_ids(batch.column(0), kind), pad, k, rounds)
                for at in range(0, len(target), BATCH):
                    step(p, sides[at : at + BATCH], target[at : at + BATCH], rate)
                seen += len(target)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array([(_flat(p).astype(np.float64) * seen).tobytes()], pa.binary()), pa.array([seen], pa.int64())], ["v", "n"])

        sent = coded.select("ids").mapInArrow(local, "v binary, n long").repartition(adders)
        with _batches(coded.sparkSession):
            got = sent.mapInArrow(_added, "v binary, n long").collect()  # a root of the tasks
        if got:
            flat = sum(np.frombuffer(r["v"], np.float64) for r in got) / sum(r["n"] for r in got)
    return _shaped(flat, shapes)


def spans(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the spans of a text's word hashes end, a hash of each one's neighbours, and of those and the span itself.

    The neighbours are two words on each side, marks beyond the text's ends.
    """
    n = len(h)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, _U), np.zeros(0, _U)
    wide = np.concatenate([np.array([1, 2], _U), h, np.array([3, 4], _U)])
    pair = (wide[:-1] * textkit._GOLD + wide[1:]) * textkit._BASE  # of the words i - 2 and i - 1 at place i
    ends = np.append(np.flatnonzero(pair[2:n] >> _U(32) & _U(SPAN - 1) == 0) + 2, n)  # SPAN is a power of two
    begins = np.append(0, ends[:-1])
    beside = textkit.mix(textkit.mix(pair[begins]) + pair[ends + 2])
    place = np.arange(n) - np.repeat(begins, ends - begins)
    inside = np.add.reduceat(h * textkit._powers(n + 1)[place + 1], begins)
    return ends, beside, textkit.mix(beside ^ textkit.mix(inside + textkit._GOLD))


@dataclass
class Lexicon:
    """Words of their own classes (hashes, codes), occurrences of the classes, held words of shared classes with their log shares, all counts."""

    words: np.ndarray
    of_class: np.ndarray
    rest: np.ndarray
    share: np.ndarray
    counts: DataFrame

    @property
    def joined(self) -> DataFrame:
        """word and share of the words that aren't held."""
        few = self.counts.filter(F.col("n") < held_from(float(self.of_class.sum())))
        n = F.element_at(F.array(*[F.lit(float(x)) for x in self.of_class[VOCABULARY:CLASSES]]), F.pmod("word", F.lit(RARE)).cast("int") + 1)
        return few.select("word", "n", F.ln(F.col("n") / n).alias("share"))


def lexicon(docs: DataFrame) -> Lexicon:
    counts = counted(docs)
    return Lexicon(*shared(*vocabulary(docs, counts)), counts)


_CODED = "uid long, doc_id long, n_words long, ids binary, ends array<long>, beside array<long>, span array<long>, first array<boolean>, share array<double>, at array<int>, few array<long>"


def coded(docs: DataFrame, known: Lexicon) -> DataFrame:
    """Class ids and spans of docs(doc_id, text), stored: ends, neighbours, the span with them, whether it is its first time in the document, held log shares; at and few are the spans and hashes of words whose share is joined."""
    words, rest, share, kind = known.words, known.rest, known.share, _kind(len(known.of_class))

    def run(batches):
        for batch in batches:
            hashes = [textkit.word_hashes(t.as_py()) for t in batch.column(2)]
            every = np.concatenate([np.zeros(0, _U), *hashes])
            own = classes(every, words)
            few = np.flatnonzero((own >= VOCABULARY) & (own < CLASSES))
            at = np.minimum(np.searchsorted(rest, every[few]), max(len(rest) - 1, 0))
            held = rest[at] == every[few] if len(rest) else np.zeros(len(few), bool)
            gain = np.zeros(len(every))
            gain[few[held]] = share[at[held]]
            left, begin, out = few[~held], 0, [[] for _ in range(9)]
            for h in hashes:
                ends, beside, span = spans(h)
                end = begin + len(h)
                here = left[np.searchsorted(left, begin) : np.searchsorted(left, end)]
                sums = np.add.reduceat(gain[begin:end], np.append(0, ends[:-1])) if len(h) else gain[:0]
                first = np.zeros(len(ends), bool)
                first[np.unique(span, return_index=True)[1]] = True
                row = (len(h), own[begin:end].astype(kind).tobytes(), ends, beside.view(np.int64), span.view(np.int64), first, sums, np.searchsorted(ends, here - begin, side="right").astype(np.int32), every[here].view(np.int64))
                for to, v in zip(out, row):
                    to.append(v)
                begin = end
            kinds = [pa.int64(), pa.binary(), *[pa.list_(x) for x in (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.int32(), pa.int64())]]
            names = ["uid", "doc_id", "n_words", "ids", "ends", "beside", "span", "first", "share", "at", "few"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(v, k) for v, k in zip(out, kinds)]], names)

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long"), "text")
    with _batches(docs.sparkSession):
        return common.stored(rows.mapInArrow(run, _CODED), "coded")


def seen(texts: DataFrame) -> DataFrame:
    """span, rows (occurrences), n (documents), total and kinds (documents and different spans with its neighbours) of spans whose neighbours several documents have, stored."""
    each = texts.select(F.explode(F.arrays_zip("beside", "span", "first")).alias("s")).select("s.beside", "s.span", "s.first")
    counts = common.stored(each.groupBy("beside", "span").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("first"), 1)).alias("n")), "spans")
    beside = counts.groupBy("beside").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).filter("total > 1")
    return common.stored(common.spread(counts, common.stored(beside, "neighbours"), ["beside"], "kinds").select("span", "rows", "n", "total", "kinds"), "seen")


def scored(docs: DataFrame, known: Lexicon | None = None, p: dict[str, np.ndarray] | None = None, texts: DataFrame | None = None) -> DataFrame:
    """doc_id, n_words, log_likelihood, per_word and network_log_likelihood (without the spans) for each row of docs(doc_id, text).

    Null, empty and wordless texts have 0 words, likelihood 0 and a null per_word.  Training sees every row, copies too;
    a span counts once for each document, and a document's own time doesn't.  An empty table gives no rows.
    """
    known = known or lexicon(docs)
    texts = texts or coded(docs, known)
    p = p or train(texts, initial(known.of_class))
    pad = len(known.of_class)
    kind = _kind(pad)

    def run(batches):
        for batch in batches:
            lists = _ids(batch.column(3), kind)
            sides, target = windows(lists, pad)
            logp = np.concatenate([np.zeros(0, np.float32), *[step(p, sides[at : at + BATCH], target[at : at + BATCH]) for at in range(0, len(target), BATCH)]]).astype(np.float64)
            sums = np.concatenate([[0.0], np.cumsum(logp)])
            ends = [x.values.to_numpy() for x in batch.column(4)]
            offset = np.cumsum([0, *map(len, lists)])
            net = [np.diff(sums[np.append(o, o + e)]) for o, e in zip(offset, ends)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(net, pa.list_(pa.float64())), *(batch.column(i) for i in range(5, 9))], ["uid", "doc_id", "n_words", "net", "span", "share", "at", "few"])

    schema = "uid long, doc_id long, n_words long, net array<double>, span array<long>, share array<double>, at array<int>, few array<long>"
    with _batches(docs.sparkSession):
        rows = common.stored(texts.select("uid", "doc_id", "n_words", "ids", "ends", "span", "share", "at", "few").mapInArrow(run, schema), "likelihood")
    met = rows.select("uid", F.explode(F.arrays_zip("at", "few")).alias("f")).select("uid", F.col("f.at").alias("pos"), F.col("f.few").alias("word")).join(known.joined.select("word", "share"), "word")
    rare = met.groupBy("uid", "pos").agg(F.sum("share").alias("rare"))
    each = rows.select("uid", F.posexplode(F.arrays_zip("net", "span", "share")).alias("pos", "s")).select("uid", "pos", (F.col("s.net") + F.col("s.share")).alias("net"), "s.span")
    each = each.join(rare, ["uid", "pos"], "left").select("uid", "span", (F.col("net") + F.coalesce("rare", F.lit(0.0))).alias("net"))
    each = common.spread(common.stored(each, "span-likelihood"), seen(texts), ["span"], "rows", "left")
    others, kinds = F.col("total") - 1, F.col("kinds") - F.when(F.col("n") == 1, 1).otherwise(0)
    weight = F.coalesce(others / (others + kinds), F.lit(0.0))
    copied = weight * F.coalesce((F.col("n") - 1) / others, F.lit(0.0))
    # log((1 - weight) * exp(net) + copied), safe where exp(net) is 0
    mixed = F.when(copied > 0, F.ln(copied) + F.log1p((1 - weight) / copied * F.exp("net"))).otherwise(F.log1p(-weight) + F.col("net"))
    sums = each.groupBy("uid").agg(F.sum(mixed).alias("ll"), F.sum("net").alias("net"))
    total = F.coalesce("ll", F.lit(0.0))
    told = rows.select("uid", "doc_id", "n_words").join(sums, "uid", "left")
    return told.select("doc_id", "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("per_word"), F.coalesce("net", F.lit(0.0)).alias("network_log_likelihood"))
