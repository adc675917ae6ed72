"""Toxicity by a weighted finite-state grammar over clauses.

Five small transducers are composed into one machine over word classes: reported speech lowers what follows it, a negation
lowers what it governs, a target before an insult raises it, a threat counts fully with a target only.  Two more read the
clause from its end, for a target and a word of reporting that come after.  An insult's own weight comes from a lexicon:
given words and, learned from labelled rows, words and word beginnings that toxic texts use far more often.  A clause, of
any length, scores the sum over its words of weight times the machines' factors; a logistic curve fitted to the labelled
rows maps a text's clause scores to a probability.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm import common, textkit

#: Labelled rows that the lexicon and the curve are fitted on, at most (about; drawn by a hash of doc_id).
FIT_ROWS = 30_000
THRESHOLD = 0.3
#: A stem is learned if so many toxic texts hold it and the likelihood ratio statistic is so large.
LEAST_TEXTS, LEAST_G2 = 4, 16.0

# Words of each class in English, German, French and Spanish.
INSULTS = "idiot moron loser stupid pathetic worthless disgusting scum trash clown dumb fool imbecile dummkopf abschaum versager crétin ordure minable idiota estúpido basura escoria".split()
THREATS = "kill hurt destroy stab shoot beat crush burn töten umbringen vernichten tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yours yourself u he she they him her them his their du dich dir dein ihr euch sie tu te toi vous ton votre tú ti usted ustedes vosotros su".split()
NEGATIONS = "not no never nor without isn aren wasn don doesn nicht kein keine nie ne pas jamais nunca sin ni".split()
REPORTS = "said says quoted quotes reported called calls wrote claimed according sagte schrieb nannte laut dit écrit selon dijo llamó escribió según".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_CLASSES = {w: c for c, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}
_BREAKS = ".;:!?\n"
_WORD, _CLAUSE = re.compile(r"[^\W_]+"), re.compile(f"[{_BREAKS}]+")
#: Words whose class a task remembers.
_REMEMBERED = 200_000


@dataclass(frozen=True)
class Transducer:
    """A sequential weighted transducer: step(state, symbol) -> (state, symbol passed on, factor of its weight)."""

    start: int
    step: Callable[[int, int], tuple[int, int, float]]


def _reported(state: int, symbol: int):
    """After a word of reporting, the clause is someone else's."""
    return (1 if symbol == REPORT else state), symbol, (0.4 if state and symbol in (INSULT, THREAT) else 1.0)


def _negated(state: int, symbol: int):
    """A negation governs the next three words."""
    if symbol == NEGATION:
        return 3, symbol, 1.0
    return max(0, state - 1), symbol, (0.3 if state and symbol in (INSULT, THREAT) else 1.0)


def _insulted(state: int, symbol: int):
    """Insults in a row strengthen each other."""
    if symbol == INSULT:
        return min(2, state + 1), symbol, 1.0 + 0.25 * state
    return (state if symbol == TARGET else max(0, state - 1)), symbol, 1.0


def _threatened(state: int, symbol: int):
    """A threat near a target weighs fully, any other a tenth."""
    if symbol == THREAT:
        return 0, symbol, 1.0 if state else 0.1
    return (3 if symbol == TARGET else max(0, state - 1)), symbol, 1.0


def _targeted(state: int, symbol: int):
    """A target shortly before an insult raises it."""
    return (4 if symbol == TARGET else max(0, state - 1)), symbol, (1.5 if state and symbol == INSULT else 1.0)


def _addressed(state: int, symbol: int):
    """A target shortly after an insult raises it (read from the end)."""
    return (2 if symbol == TARGET else max(0, state - 1)), symbol, (1.5 if state and symbol == INSULT else 1.0)


def _attributed(state: int, symbol: int):
    """A word of reporting among the next four words lowers what it comes after (read from the end)."""
    return (4 if symbol == REPORT else max(0, state - 1)), symbol, (0.4 if state and symbol in (INSULT, THREAT) else 1.0)


def composed(parts: list[Transducer]) -> tuple[np.ndarray, np.ndarray]:
    """The product machine as tables next[state, symbol] and factor[state, symbol]; state 0 starts."""
    index = {tuple(p.start for p in parts): 0}
    queue, nexts, factors = list(index), [], []
    for state in queue:
        row, gain = [], []
        for symbol in range(6):
            to, passed, factor = [], symbol, 1.0
            for part, own in zip(parts, state):
                own, passed, f = part.step(own, passed)
                to.append(own)
                factor *= f
            if (key := tuple(to)) not in index:
                index[key] = len(index)
                queue.append(key)
            row.append(index[key])
            gain.append(factor)
        nexts.append(row)
        factors.append(gain)
    return np.array(nexts), np.array(factors)


def machine(forward: bool = True) -> tuple[list, list]:
    steps = (_reported, _negated, _threatened, _targeted, _insulted) if forward else (_addressed, _attributed)
    nexts, factors = composed([Transducer(0, f) for f in steps])
    return nexts.tolist(), factors.tolist()


class Grammar:
    """Scores clauses by the composed machines.  lexicon: "=word" or "^beginning" -> weight."""

    def __init__(self, lexicon: dict[str, float]):
        import ahocorasick

        self.whole = {k[1:]: w for k, w in lexicon.items() if k[0] == "="}
        self.begin = {k[1:]: w for k, w in lexicon.items() if k[0] == "^"}
        self.sizes = sorted({len(k) for k in self.begin})
        self.threats = set(THREATS)
        self.find = ahocorasick.Automaton()
        for word in {*self.whole, *self.begin, *self.threats}:
            self.find.add_word(word, len(word))
        self.find.make_automaton()
        self.next, self.factor = machine()
        self.back, self.gain = machine(forward=False)
        self.known: dict[str, tuple[int, float]] = {}

    def weight(self, word: str) -> float:
        return max([self.whole.get(word, 0.0), *(self.begin.get(word[:n], 0.0) for n in self.sizes if len(word) >= n)])

    def read(self, word: str) -> tuple[int, float]:
        """A word's class and weight."""
        if (out := self.known.get(word)) is None:
            w = self.weight(word)
            out = (INSULT, w) if w else (THREAT, 2.0) if word in self.threats else (_CLASSES.get(word, OTHER), 0.0)
            if len(self.known) < _REMEMBERED:
                self.known[word] = out
        return out

    def clause(self, text: str) -> float:
        """The score of one lower-cased clause."""
        symbols, gains, state, total = bytearray(), {}, 0, 0.0
        for m in _WORD.finditer(text):
            symbol, w = self.read(m[0])
            if w:
                gains[len(symbols)] = w * self.factor[state][symbol]
            symbols.append(symbol)
            state = self.next[state][symbol]
        state = 0
        for at in range(len(symbols) - 1, min(gains, default=0) - 1, -1):
            if at in gains:
                total += gains[at] * self.gain[state][symbols[at]]
            state = self.back[state][symbols[at]]
        return total

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        """Largest clause score, log of their sum, log of the sum a word, log of the matched clauses."""
        if not text:
            return 0.0, 0.0, 0.0, 0.0
        low, scores, done = text.lower(), [], 0
        for end, n in self.find.iter(low):
            at = end - n + 1
            if at < done or (at and (low[at - 1].isalnum())):
                continue
            head = max(done, *(low.rfind(x, done, at) + 1 for x in _BREAKS))
            done = m.start() if (m := _CLAUSE.search(low, end)) else len(low)
            if (s := self.clause(low[head:done])) > 0:
                scores.append(s)
        if not scores:
            return 0.0, 0.0, 0.0, 0.0
        total = sum(scores)
        return max(scores), math.log1p(total), math.log1p(1000 * total / (low.count(" ") + 1)), math.log1p(len(scores))


@dataclass
class Model:
    lexicon: dict[str, float]
    curve: list[float]


def _stems(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        counts = {1: Counter(), 0: Counter()}
        for text, toxic in zip(f["text"], f["toxic"]):
            words = set(_WORD.findall((text or "").lower()))
            counts[int(toxic)].update({"=" + w for w in words} | {"^" + w[:n] for w in words for n in (4, 5, 6) if len(w) > n})
        keys = list(counts[1] | counts[0])
        yield pd.DataFrame({"stem": keys, "t": [counts[1][k] for k in keys], "c": [counts[0][k] for k in keys]})


def _least_shingles(texts: pd.Series) -> pd.Series:
    """A hash of the three smallest shingle hashes: near copies mostly share it, other texts practically never."""
    out = []
    for x in texts:
        h = np.unique(textkit.shingle_hashes(textkit.word_hashes(x)))[:3]
        out.append(int(textkit.mix(textkit.mix(h) + np.arange(len(h), dtype=np.uint64)).sum(dtype=np.uint64).view(np.int64)) if len(h) else 0)
    return pd.Series(out, dtype="int64")


def fit(rows: DataFrame) -> Model:
    """Learns from rows(text, toxic): one row of each set of near copies (the one whose text has the least hash), so that a text copied often counts once.

    rows has to be bounded (see FIT_ROWS).  Without rows of both classes the given words alone make the score.
    """
    first = F.pandas_udf(_least_shingles, "long")
    ready = rows.filter("toxic in (0, 1)").select("text", F.col("toxic").cast("int").alias("toxic"))
    fitted = common.stored(ready.withColumn("first", first("text")).groupBy("first", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "toxic-fit")
    n = {r[0]: r[1] for r in fitted.groupBy("toxic").count().collect()}
    nt, nc = n.get(1, 0), n.get(0, 0)
    lexicon = {"=" + w: 2.0 for w in INSULTS}
    if not nt or not nc:
        return Model(lexicon, [-3.0, 0.5, 1.0, 0.0, 0.0])
    stems = fitted.select("text", "toxic").mapInPandas(_stems, "stem string, t long, c long").groupBy("stem").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    odds = F.log((F.col("t") + 0.5) / (nt + 1)) - F.log((F.col("c") + 0.5) / (nc + 1))
    g2 = 2 * F.col("t") * (F.log(F.col("t") / nt) - F.log((F.col("t") + F.col("c")) / (nt + nc)))
    known = stems.filter(F.col("t") >= LEAST_TEXTS).filter(F.col("stem").substr(2, 99).isin(INSULTS) | ((g2 >= LEAST_G2) & (odds >= 2)))
    for r in known.select("stem", odds.alias("w")).collect():  # bounded as the rows are
        if r["w"] >= 1 or r["stem"] not in lexicon:
            lexicon[r["stem"]] = max(r["w"], 0.1)

    def featured(frames):
        grammar = Grammar(lexicon)
        for f in frames:
            x = np.array([grammar.features(t) for t in f["text"]]).reshape(-1, 4)
            yield pd.DataFrame({f"x{i}": x[:, i] for i in range(4)} | {"y": f["toxic"].to_numpy()})

    seen = fitted.select("text", "toxic").mapInPandas(featured, "x0 double, x1 double, x2 double, x3 double, y int").groupBy("x0", "x1", "x2", "x3", "y").count().toPandas()
    x = np.column_stack([np.ones(len(seen)), seen[["x0", "x1", "x2", "x3"]].to_numpy()])
    return Model(lexicon, logistic(x, seen["y"].to_numpy(), seen["count"].to_numpy()).tolist())


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Weighted logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(b))
    keep[0, 0] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (p - y)) + keep @ b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + keep + 1e-9 * np.eye(len(b))
        d = np.linalg.solve(h, g)
        b = b - d / max(1.0, np.abs(d).max() / 3)
        if np.abs(d).max() < 1e-8:
            break
    return b


def labelled(docs: DataFrame, labels: DataFrame, fold: int | None = None) -> DataFrame:
    """text and toxic of at most about FIT_ROWS labelled documents; those of crc32(doc_id) mod 4 = fold are left out.

    The broadcast side is bounded by FIT_ROWS: of more labels a hash of doc_id draws so many.
    """
    known = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if fold is not None:
        known = known.filter(crc(F.col("doc_id")) % 4 != fold)
    many = known.count()
    if many > FIT_ROWS:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * FIT_ROWS / many)))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic")


def crc(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary"))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score (0 to 1) for each row of docs(doc_id, text); null and empty texts score as texts without a match."""
    import pyarrow as pa

    def run(batches):
        grammar, b = Grammar(model.lexicon), model.curve
        for batch in batches:
            out = []
            for text in batch.column(1):
                x = grammar.features(text.as_py())
                z = b[0] + sum(w * v for w, v in zip(b[1:], x))
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score below the threshold, with all columns."""

    def run(frames):
        grammar, b = Grammar(model.lexicon), model.curve
        for text in frames:
            z = [b[0] + sum(w * v for w, v in zip(b[1:], grammar.features(t))) for t in text]
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def score(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return run(frames)

    return docs.filter(F.pandas_udf(score, "double")("text") < threshold)
