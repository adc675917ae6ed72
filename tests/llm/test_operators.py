"""Training-data operators against brute force, on nulls, empty tables, repeated rows and clashing columns."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from gridframe.llm import bagminhash, common, embedding_dups, fingerprints, packing, pfair, pseudo_likelihood, queries, sharding, textkit, token_counts, tokens, toxicity, warc

DIR = "/root/testdata/sf0.001"
LONG = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua " * 40
TEXTS = [(1, "a b c d e f g h"), (2, None), (3, ""), (4, "A b, c d e f g h!"), (4, "A b, c d e f g h!"), (5, LONG), (None, "x y z"), (6, "***"), (7, "one"), (8, "one"), (9, LONG + "x"), (10, "x" * 50_000)]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return common.stored(spark.createDataFrame([(*t, f"s{i % 2}", None, 1) for i, t in enumerate(TEXTS)], SCHEMA + ", source string, uid string, position int"), "test")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(compare, name):
    compare(queries.QUERIES[name], queries.SQL[name], DIR)


def test_op1_revisits(spark):
    body = "y" * 150 + "\r\n\r\nWARC/1.1 é"
    rows = [(5, "u5", body), (3, "u3", body), (7, "a", "short"), (8, "b", "short"), (9, None, None), (None, "n", body), (3, "u3", body)]
    pages = common.stored(spark.createDataFrame(rows, "page_id long, url string, html string"), "pages")
    got = warc.archived_pages(pages).collect()
    assert len(got) == len(rows)
    assert sorted((r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["page_id"]) == [(3, "response", None), (3, "revisit", 3), (5, "revisit", 3), (7, "response", None), (8, "response", None), (9, "response", None)]
    assert {r["payload_digest"] for r in got if r["page_id"] in (3, 5)} == {hashlib.sha256(body.encode()).hexdigest()}
    assert {r["payload_bytes"] for r in got if r["page_id"] in (3, 5)} == {len(body.encode())}
    assert warc.archived_pages(pages.limit(0)).count() == 0


def test_op1_archives_with_revisits_are_written_anew(spark, monkeypatch):
    import gzip
    import os

    monkeypatch.setattr(warc, "FILE_CHUNKS", 1)
    raw, new, last = (common.new_path(spark, x) for x in ("raw", "new", "last"))
    texts = {"a": "y" * 150, "b": "y" * 150, "c": "short", "d": "short", "e": None, "f": "z" * 3_000_000 + "\r\n\r\nWARC/1.1", "g": "y" * 150}
    rows = spark.createDataFrame([(f"http://{k}", k, v) for k, v in texts.items()], "uri string, key string, payload string").repartition(1)
    warc.write(rows, raw, "2020-01-01T00:00:00Z")
    ids = {r["key"]: r["record_id"] for r in warc.read(spark, raw).collect()}
    assert len(ids) == len(set(ids.values())) == len(texts) and all(x.startswith("<urn:uuid:") for x in ids.values())
    # a foreign archive, one gzip stream, revisits these by digest, by name and not at all; a conversion is left out
    sha = hashlib.sha256(b"short").hexdigest()
    foreign = [("r1", f"sha256:{sha}", None, "revisit"), ("r2", "sha1:ABC", ids["b"], "revisit"), ("r3", "sha1:ABC", "<urn:uuid:none>", "revisit"), ("r4", "sha256:none", None, "revisit"), ("r5", None, None, "conversion")]
    flat = b""
    for key, digest, to, kind in foreign:
        flat += warc.record([("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{key}>"), ("X-Row-Key", key), ("WARC-Payload-Digest", digest), ("WARC-Refers-To", to), ("Content-Type", "application/http")], b"HTTP/1.1 200 OK\r\n\r\n") + b"\r\n\r\n"
    with open(raw.removeprefix("file://") + "/foreign.warc.gz", "wb") as f:
        f.write(gzip.compress(flat))
    warc.deduplicate(spark, raw, new, date="2021-01-01T00:00:00Z")
    warc.deduplicate(spark, new, last)  # once more changes nothing
    for path in (new, last):
        got = {r["key"]: r for r in warc.resolved(common.stored(warc.read(spark, path), "heads")).collect()}
        assert {k for k, r in got.items() if r["type"] == "response"} == set("acdef")
        assert {k: r["first"] and r["first"]["key"] for k, r in got.items() if r["type"] == "revisit"} == {"b": "a", "g": "a", "r1": "c", "r2": "a", "r3": None, "r4": None}
        assert all(r["type"] == r["kind"] for r in got.values()) and len({r["record_id"] for r in got.values()} | set(ids.values())) == len(got) + len(ids)
        assert got["f"]["digest"] == hashlib.sha256(texts["f"].encode()).hexdigest() and got["b"]["refers_to_id"] == got["a"]["record_id"]
        assert (got["r3"]["said_digest"], got["b"]["said_bytes"]) == ("sha1:ABC", 150)
    by = {at: (h, body) for at, h, body in (x for name in sorted(os.listdir(new.removeprefix("file://"))) if name.startswith("part") for x in warc.parsed(open(new.removeprefix("file://") + "/" + name, "rb").read()))}
    assert {h["warc-date"] for h, _ in by.values()} == {"2021-01-01T00:00:00Z"}


def test_op1_parses_members_streams_and_plain_archives():
    import gzip

    bodies = [b"a" * n + b"\r\n\r\n" for n in (0, 5, 70_000, 300_000)]
    records = [warc.response(f"<{i}>", "d", f"u\r\n{i}", None, b) for i, b in enumerate(bodies)]
    plain = b"".join(r + b"\r\n\r\n" for r in records)
    for data in (warc._SEPARATOR.join(map(warc.zipped, records)), warc._SEPARATOR.join([warc.zipped(records[0]), warc.zipped(b"\r\n\r\n".join(records[1:]))]), plain, gzip.compress(plain), b"\r\n" + plain):
        got = list(warc.parsed(data))
        assert [body for *_, body in got] == bodies and [h["warc-target-uri"] for _, h, _ in got] == [f"u {i}" for i in range(4)]
        assert len({at for at, *_ in got}) == 4
    for data in (plain[:-9], gzip.compress(plain)[:-9], plain + b"WARC", b"x" + plain):
        with pytest.raises(ValueError):
            list(warc.parsed(data))


def test_op2_beats_word_frequencies(spark, docs, empty):
    table = common.table(spark, DIR, "documents")
    got = pseudo_likelihood.scored(table).toPandas()
    words, size = pseudo_likelihood.vocabulary(table)
    share, total, n = np.log(size / size.sum()), 0.0, 0
    for r in table.select("text").collect():
        c = pseudo_likelihood.classes(textkit.word_hashes(r[0]), words)
        total, n = total + share[c].sum(), n + len(c)
    assert got["n_words"].sum() == n and got["network_log_likelihood"].sum() / n > total / n and got["log_likelihood"].sum() > got["network_log_likelihood"].sum()
    # one long task: many steps from one start
    larger = common.table(spark, "/root/testdata/sf0.01", "documents")
    known = pseudo_likelihood.lexicon(larger)
    many = pseudo_likelihood.scored(larger, known).toPandas()
    c = known.counts.toPandas()["n"].to_numpy(float)
    assert many["network_log_likelihood"].sum() > (c * np.log(c / c.sum())).sum() and many["n_words"].sum() == c.sum()
    # the two-level softmax is normalised
    p = pseudo_likelihood.initial(np.ones(pseudo_likelihood.CLASSES))
    sides = np.full((pseudo_likelihood.CLASSES, 4), 5)
    assert np.exp(pseudo_likelihood.step(p, sides, np.arange(pseudo_likelihood.CLASSES)).astype(float)).sum() == pytest.approx(1, abs=1e-4)
    odd = {(r["doc_id"], r["n_words"]): r["per_word"] for r in pseudo_likelihood.scored(docs).collect()}
    assert odd[(2, 0)] is None and odd[(6, 0)] is None and odd[(1, 8)] < 0
    assert pseudo_likelihood.scored(empty).count() == 0


@pytest.mark.parametrize("held", [300, 2])
def test_op2_against_every_document_by_hand(spark, monkeypatch, held):
    model = pseudo_likelihood
    monkeypatch.setattr(model, "HELD", held)
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(1500)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    texts = [line(rnd.choice([1, 2, 3, 40, 200])) for _ in range(60)] + [line(150)] * 2 + [line(80)] * 5 + ["", None, "w1", "w1", "w1 w1 " * 300]
    texts += [texts[0] + " " + texts[60], texts[60][:200]]
    table = common.stored(spark.createDataFrame(list(enumerate(texts)), SCHEMA), "by-hand")
    known = model.lexicon(table)
    coded = model.coded(table, known)
    p = model.train(coded, model.initial(known.of_class))
    got = {r["doc_id"]: r for r in model.scored(table, known, p, coded).collect()}
    count = Counter(w for t in texts for w in textkit.word_hashes(t).tolist())
    size = known.of_class
    logits = lambda h, w, b: (z := h @ w + b) - np.log(np.exp(z).sum())

    def log_p(h, i):
        """A word's log-probability given two words on each side, and its share of its class."""
        codes = [int(model.classes(h[k : k + 1], known.words)[0]) if 0 <= k < len(h) else len(size) for k in (i - 2, i - 1, i + 1, i + 2)]
        own = int(model.classes(h[i : i + 1], known.words)[0])
        hidden = np.tanh(np.concatenate([p["embed"][c] for c in codes]).astype(float) @ p["w1"] + p["b1"])
        g, c = divmod(own, len(p["bg"]))
        out = logits(hidden, p["wg"], p["bg"])[g] + logits(hidden, p["wc"][g], p["bc"][g])[c]
        return out + (np.log(count[int(h[i])] / size[own]) if model.VOCABULARY <= own < model.CLASSES else 0)

    cut = {}
    for i, t in enumerate(texts):
        h = textkit.word_hashes(t)
        mark = [1, 2, *h.tolist(), 3, 4]
        ends = [k for k in range(2, len(h)) if (int(mark[k]) * int(textkit._GOLD) + int(mark[k + 1])) * int(textkit._BASE) % 2**64 >> 32 & model.SPAN - 1 == 0]
        cut[i] = [(a, b, tuple(mark[a : a + 2]), tuple(h[a:b].tolist()), tuple(mark[b + 2 : b + 4])) for a, b in zip([0, *ends], [*ends, len(h)]) if len(h)]
    n = Counter(x for c in cut.values() for x in {(a, s, b) for _, _, a, s, b in c})
    total, kinds = Counter(), Counter()
    for (a, _, b), k in n.items():
        total[a, b] += k
        kinds[a, b] += 1
    assert max(n.values()) > 4 and any(k == 1 and total[a, b] > 1 for (a, _, b), k in n.items())
    for i, t in enumerate(texts):
        h, want, net = textkit.word_hashes(t), 0.0, 0.0
        for begin, end, a, s, b in cut[i]:
            own = sum(log_p(h, k) for k in range(begin, end))
            others, seen = total[a, b] - 1, n[a, s, b]
            weight = others / (others + kinds[a, b] - (seen == 1)) if others else 0.0
            net += own
            want += np.log((1 - weight) * np.exp(own) + weight * (seen - 1) / others) if seen > 1 else np.log(1 - weight) + own
        assert got[i]["n_words"] == len(h) and got[i]["network_log_likelihood"] == pytest.approx(net, rel=1e-3, abs=1e-3) and got[i]["log_likelihood"] == pytest.approx(want, rel=1e-3, abs=1e-3)
    once, twice = got[0]["per_word"] if len(texts[0].split()) > 3 else got[10]["per_word"], got[60]["per_word"]
    assert twice > once / 4  # a text written twice is far likelier


def test_op3_packs_every_piece_once(spark, docs, empty):
    got = packing.packed(docs).toPandas()
    encoder = tokens.encoder(tokens.default_path())
    want = []
    for doc, text in TEXTS:
        ids = [*(encoder.exact(text) if text else []), 2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(doc, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for a, b in zip(cuts, cuts[1:])]
    key = lambda rows: sorted((repr(None if d is None or d != d else int(d)), a, n, c) for d, a, n, c in rows)
    assert key(got[["doc_id", "start", "length", "ids_crc32"]].itertuples(index=False)) == key(want)
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g["offset"].to_numpy() == np.cumsum(g["length"]) - g["length"]).all() and g["length"].sum() <= 1024
    assert packing.packed(empty).count() == 0


def test_op3_keeps_large_ids_beside_nulls(spark):
    rows = [((1 << 60) + 1, "a b"), (None, "a"), ((1 << 60) + 3, "c")]
    got = [r["doc_id"] for r in packing.packed(common.stored(spark.createDataFrame(rows, SCHEMA).repartition(1), "large")).collect()]
    assert sorted(map(repr, got)) == sorted(repr(i) for i, _ in rows)


def test_op3_comes_near_the_bound():
    rng = np.random.default_rng(0)
    hist: dict[int, int] = {}
    for v in np.clip(rng.lognormal(6, 1, 50_000), 1, 1024).astype(int).tolist():
        hist[v] = hist.get(v, 0) + 1
    plan = packing.plan(dict(hist))
    held: dict[int, int] = {}
    for pattern, many in plan:
        assert sum(x * k for x, k in pattern.items()) <= 1024
        for x, k in pattern.items():
            held[x] = held.get(x, 0) + k * many
    assert held == hist
    bound = -(-sum(x * n for x, n in hist.items()) // 1024)
    assert sum(m for _, m in plan) <= 1.005 * bound


def test_op3_ids_are_those_of_tokenizers():
    encoder, rnd = tokens.encoder(tokens.default_path()), random.Random(5)
    assert encoder.fast is not None
    letters = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x3000, 0x85, 0x1F600, 0x4E00, 0x301, 0x660]]
    for _ in range(400):
        text = "".join(rnd.choice(letters) if rnd.random() < 0.5 else rnd.choice(" ab\n\t1'sdt.<|endoftext|>") for _ in range(rnd.randint(1, 60)))
        assert encoder.ids(text).tolist() == encoder.exact(text)


def test_op4_held_out(spark, docs, empty):
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in common.table(spark, sf, "labels").collect()}
    rows = [r for r in queries.op4_toxicity_grammar(spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in rows)
    hit = sum(r["predicted"] and labels[r["doc_id"]] for r in rows)
    assert hit / sum(r["predicted"] for r in rows) > 0.9 and hit / sum(labels[r["doc_id"]] for r in rows) > 0.9
    model = toxicity.Model({"=" + w: 2.0 for w in toxicity.INSULTS}, [-3, 0.5, 1, 0, 0])
    assert toxicity.scored(docs, model).count() == len(TEXTS) and toxicity.scored(empty, model).count() == 0
    assert toxicity.fit(empty.selectExpr("text", "1 as toxic")).curve[0] < 0


def test_op4_grammar_weighs_clauses():
    g = toxicity.Grammar({"=idiot": 2.0})
    plain, targeted, negated, reported = (g.clause(x) for x in ("what an idiot", "you are an idiot", "you are not an idiot", "he said you are an idiot"))
    assert targeted > plain > negated and targeted > reported
    assert g.clause("i will kill you") < g.clause("you i will kill")


def test_op4_features_are_those_of_every_clause():
    import re

    g = toxicity.Grammar({"=idiot": 2.0, "^mor": 1.5, "=scum": 3.0})
    assert g.features("he said " + "word " * 900 + "you are an idiot")[0] == g.clause("he said " + "word " * 900 + "you are an idiot") == pytest.approx(1.2)
    assert g.clause("you are an idiot he said") < g.clause("you are an idiot") and g.clause("idiot you") > g.clause("idiot")
    rnd = random.Random(3)
    words = [*toxicity.TARGETS, *toxicity.NEGATIONS, *toxicity.REPORTS, *toxicity.THREATS, *["word"] * 150, *["idiot", "MORONS", "scum", "xidiot", "idiots", "mor", "é"] * 4]
    for _ in range(300):
        text = "".join(rnd.choice(words) + rnd.choice([" "] * 30 + [".", "! ", "\n", ", ", "_", "?!"]) for _ in range(rnd.choice([3, 30, 900])))
        scores = [s for c in re.split(r"[.;:!?\n]+", text.lower()) if (s := plain_clause(g, re.findall(r"[^\W_]+", c))) > 0]
        want = (max(scores), np.log1p(sum(scores)), np.log1p(1000 * sum(scores) / (text.count(" ") + 1)), np.log1p(len(scores))) if scores else (0, 0, 0, 0)
        assert g.features(text) == pytest.approx(want)


def plain_clause(g, words):
    """The rules of the grammar, word by word, without its machines."""
    kind = ["insult" if g.weight(w) else "threat" if w in toxicity.THREATS else "target" if w in toxicity.TARGETS else "not" if w in toxicity.NEGATIONS else "report" if w in toxicity.REPORTS else "" for w in words]
    total = run = 0.0
    for i, k in enumerate(kind):
        within = lambda what, n: any(x == what for x in kind[max(0, i - n) : i])  # noqa: B023, E731
        if k == "insult":
            f = (1.5 if within("target", 4) else 1) * (1.5 if "target" in kind[i + 1 : i + 3] else 1) * (1 + 0.25 * run)
        elif k == "threat":
            f = 1.0 if any(x == "target" and "threat" not in kind[j + 1 : i] for j, x in enumerate(kind[:i]) if j >= i - 3) else 0.1
        if k in ("insult", "threat"):
            f *= (0.4 if "report" in kind[:i] else 1) * (0.3 if within("not", 3) else 1) * (0.4 if "report" in kind[i + 1 : i + 5] else 1)
            total += (g.weight(words[i]) or 2.0) * f
        run = min(2, run + 1) if k == "insult" else run if k == "target" else max(0, run - 1)
    return total


def test_op5_counts(spark, docs, empty):
    encoder = tokens.encoder(tokens.default_path())
    want = sorted((repr(d), len(encoder.ids(t))) for d, t in TEXTS)
    assert sorted((repr(r["doc_id"]), r["n_tokens"]) for r in token_counts.counted(docs).collect()) == want
    assert token_counts.counted(empty).count() == 0
    # blocks far smaller than documents give the same, and so do ids of 32 bits
    assert token_counts.end_of(tokens.default_path()) == 0xFFFF
    for end in (0xFFFF, 0xFFFFFFFF):
        path = common.new_path(spark, "tokens")
        token_counts.write(docs, path, end=end)
        assert sorted(r["n_tokens"] for r in token_counts.scan(spark, path, end, block_bytes=64).collect()) == sorted(n for _, n in want)


def test_op5_places_documents_over_files_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(token_counts, "FILE_CHUNKS", 1)
    rnd, encoder = random.Random(8), tokens.encoder(tokens.default_path())
    rows = [(i, "word " * rnd.choice([0, 1, 7, 100, 90_000 if i % 40 == 0 else 3])) for i in range(600)]
    table = common.stored(spark.createDataFrame(rows, SCHEMA).repartition(3), "many")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.counted(table).collect()}
    lengths = {n: len(encoder.ids("word " * n)) for n in (0, 1, 3, 7, 100, 90_000)}
    assert got == {i: lengths[t.count("word")] for i, t in rows}


def test_op6_every_shard_fits(spark, docs, empty):
    from pyspark.sql import functions as F

    rows = common.stored(spark.createDataFrame([(i if i > 300 else 7, 100 + i % 50) for i in range(1000)], "k long, size int"), "rows")
    got = sharding.sharded(rows, ["k"], F.col("size"), 2000).toPandas()
    sums = got.groupby("shard").agg(b=("bytes", "sum"), said=("shard_bytes", "first"), d=("depth", "first"))
    assert len(got) == 1000 and (sums["b"] <= 2000).all() and (sums["b"] == sums["said"]).all() and (sums.index.str.len() == sums["d"]).all()
    shards = sorted(sums.index)
    assert not any(b.startswith(a) for a, b in zip(shards, shards[1:]))
    # a bucket was split only because its parent was too large
    for s in shards:
        assert s == "" or got[got["shard"].str.startswith(s[:-1])]["bytes"].sum() > 2000
    assert sums["d"].nunique() > 3 and all(e.startswith(x) for e, x in zip(got["entry"], got["shard"]))
    # each index of a directory names one shard, the first that fits
    cells = spark.createDataFrame([("00", 5, 1), ("01", 6, 2), ("10", 9, 3), ("11", 30, 2)], "entry string, b long, n long")
    assert sorted((r["entry"], r["shard"], r["shard_bytes"]) for r in sharding.directory(cells, 0, 2, 11).collect()) == [("00", "0", 11), ("01", "0", 11), ("10", "10", 9)]
    clash = rows.selectExpr("k", "size as bytes", "k as shard", "size as _bits", "k as Entry")
    assert sharding.sharded(clash, ["k"], F.col("bytes"), 2000).select("k", "_bits", "shard", "bytes").count() == 1000
    size = F.octet_length("text")
    assert sharding.sharded(docs, ["doc_id"], size, 1000).count() == len(TEXTS) and sharding.sharded(empty, ["doc_id"], size, 1000).count() == 0


def test_op7_against_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(32)
    rows = [(i, [float(x) for x in (base + rng.standard_normal(32) * 0.13 * rng.random()).astype(np.float32)], i % 2) for i in range(700)]
    rows += [(i, rows[7][1], 1) for i in range(700, 760)]
    rows += [(800, None, 1), (801, [0.0] * 32, 1), (802, [float("nan")] + [1.0] * 31, 1), (803, rows[3][1], None), (804, [], 1)]
    v = np.array([r[1] for r in rows[:760]], float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows[:760]])
    link = (v @ v.T >= embedding_dups.COSINE) & (label[:, None] == label[None, :])
    np.fill_diagonal(link, False)
    low = np.arange(760)
    while True:
        new = np.array([min(low[i], *low[np.flatnonzero(link[i])], low[i]) for i in range(760)])
        if (new == low).all():
            break
        low = new
    table = common.stored(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), "vectors")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dups.classes(table).collect()}
    assert got == {i: (int(link[i].sum()), int(low[i]), bool(low[i] == i)) for i in range(760)} | {i: (0, i, True) for i in range(800, 805)}
    assert embedding_dups.classes(table.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [24, 64, 200])
def test_op7_estimates_are_unbiased(dim):
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((2, 4000, dim))
    for mixed in (a + b, a + 0.15 * b):
        one, other = (embedding_dups.units(list(x)) for x in (a, mixed))
        real = (one * other).sum(axis=1)
        got, error = embedding_dups.estimate(embedding_dups.codes(one), embedding_dups.codes(other, 1), dim, real.min())
        assert abs((got - real).mean()) < 0.01 and (np.abs(got - real) < error).all()


def test_op7_keeps_double_precision(spark):
    v = np.random.default_rng(2).standard_normal(64)
    w = v.copy()
    w[0] += 1e-12  # the same in single precision
    turned = np.linalg.qr(np.stack([v, np.random.default_rng(4).standard_normal(64)]).T)[0].T
    at = lambda c: (c * turned[0] + np.sqrt(1 - c * c) * turned[1]).tolist()
    rows = [(1, turned[0].tolist(), 1), (2, at(0.98 + 1e-10), 1), (3, (-turned[0]).tolist(), 2), (4, [-x for x in at(0.98 - 1e-10)], 2), (5, v.tolist(), 3), (6, w.tolist(), 3)]
    table = common.stored(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "doubles")
    assert {r["vec_id"]: r["n_links"] for r in embedding_dups.classes(table).collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1, 6: 1}


def test_op8_against_sets(spark, docs, empty):
    import re

    rows = [(i, t) for i, t in enumerate([t for _, t in TEXTS] + ["abc\ndef\n\nabc", "é" * 400, "\n".join(str(k) for k in range(700)), "abc\ndef\nabc\nabc", "a\n" * 3000, "a\n" * 4000])]
    table = common.stored(spark.createDataFrame(rows, SCHEMA), "texts")
    got = {r["doc_id"]: r for r in fingerprints.compared(table).collect()}

    def units(t):
        cut = re.findall(r"[^\n]{1,%d}" % fingerprints.SHORT, t[: fingerprints.OPENING]) + re.findall(r"[^\n]{1,%d}" % fingerprints.PIECE, t[fingerprints.OPENING :])
        return {(x, k) for x, n in Counter(cut).items() for k in range(n)}

    dice = lambda a, b: 2 * len(a & b) / (len(a) + len(b)) if a or b else 1.0
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        t, other = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t) // 3
        edited = t[: len(t) - n] + other[:n]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[i]["near_edited"] == pytest.approx(dice(units(t), units(edited))) and got[i]["near_next"] == pytest.approx(dice(units(t), units(other)))
    assert got[7]["fingerprint"] != "" and len({r["fingerprint"] for r in got.values() if rows[r["doc_id"]][1] == TEXTS[3][1]}) == 1
    assert fingerprints.compared(docs).count() == len(TEXTS) and fingerprints.compared(empty).count() == 0


def test_rows_keep_their_ids_however_a_scan_is_cut(spark):
    table = common.table(spark, "/root/testdata/sf0.1", "documents").select("doc_id")
    assert common.steady(table) is table
    before = {r["doc_id"]: r["uid"] for r in common.with_row_id(table, "uid").collect()}
    with common.setting(spark, "spark.sql.leafNodeDefaultParallelism", "2"):
        after = {r["doc_id"]: r["uid"] for r in common.with_row_id(table, "uid").collect()}
    assert before == after and len(set(before.values())) == len(before) == 10_000
    made = common.steady(spark.createDataFrame([(1, 2), (1, 2)], "_file int, uid long"))
    assert common.with_row_id(made, "row").columns == ["_file", "uid", "row"] and common.with_row_id(made, "row").select("row").distinct().count() == 2


def test_hot_keys_are_joined_like_others(spark, monkeypatch):
    monkeypatch.setattr(common, "LEAST_HOT", 20)
    rows = common.stored(spark.createDataFrame([(i % 7 if i % 2 else 100, i) for i in range(300)], "k long, v long"), "rows")
    table = common.stored(rows.groupBy("k").count().filter("k <> 3"), "counts")
    want = sorted(map(tuple, rows.join(table, "k").collect()))
    assert sorted(map(tuple, common.spread(rows, table, ["k"], "count").collect())) == want and len(want) > 200
    assert common.spread(rows, table, ["k"], "count", "left").count() == 300


def test_op9_signatures_are_unbiased():
    rng, off = np.random.default_rng(1), []
    for _ in range(100):
        v = np.sort(rng.integers(0, 2**63, 60).astype(np.uint64))
        a = rng.integers(1, 40, 60)
        b = np.where(rng.random(60) < 0.3, rng.integers(1, 40, 60), a)
        off.append((bagminhash.signature(v, a) == bagminhash.signature(v, b)).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.012 and np.std(off) < 0.05


def test_op9_against_all_pairs(spark, docs, empty):
    table = common.table(spark, DIR, "documents")
    rows = table.select("doc_id", "text").collect()
    bags, low = [textkit.bag(r["text"]) for r in rows], list(range(len(rows)))
    find = lambda i: i if low[i] == i else find(low[i])
    for i in range(len(rows)):
        for j in range(i):
            if textkit.overlap(bags[i], bags[j]) >= bagminhash.SIMILARITY:
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
    want = {}
    for i, r in enumerate(rows):
        want.setdefault(find(i), []).append(r["doc_id"])
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(table).collect()}
    assert got == {d: min(g) for g in want.values() for d in g}
    odd = sorted((repr(r["doc_id"]), r["class_id"], r["class_size"], r["kept"]) for r in bagminhash.classes(docs).collect())
    assert odd == sorted([("1", 1, 3, True), ("2", 2, 1, True), ("3", 3, 1, True), ("4", 1, 3, False), ("4", 1, 3, False), ("5", 5, 2, True), ("None", None, 1, True), ("6", 6, 1, True), ("7", 7, 2, True), ("8", 7, 2, False), ("9", 5, 2, False), ("10", 10, 1, True)])
    assert bagminhash.deduplicated(docs).count() == 8 and bagminhash.deduplicated(docs).columns == docs.columns
    assert bagminhash.classes(empty).count() == 0


@pytest.mark.parametrize("small", [False, True])
def test_op9_against_all_pairs_that_share_a_shingle(spark, monkeypatch, small):
    table = common.table(spark, "/root/testdata/sf0.01", "documents")
    if small:  # tiny groups, blocks and hot keys give the same
        monkeypatch.setattr(bagminhash, "BLOCK", 4)
        monkeypatch.setattr(bagminhash, "GROUP", 2)
        monkeypatch.setattr(common, "LEAST_HOT", 3)
    rows = table.select("doc_id", "text").collect()
    bags, low, holders = [textkit.bag(r["text"]) for r in rows], list(range(len(rows))), {}
    find = lambda i: i if low[i] == i else find(low[i])
    for i, (shingles, _) in enumerate(bags):
        shared = Counter(j for x in shingles.tolist() for j in holders.get(x, ()))
        for j in shared:
            if textkit.overlap(bags[i], bags[j]) >= bagminhash.SIMILARITY:
                a, b = find(i), find(j)
                low[max(a, b)] = min(a, b)
        for x in shingles.tolist():
            holders.setdefault(x, []).append(i)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(find(i), []).append(r["doc_id"])
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(table).collect()}
    assert got == {d: min(g) for g in groups.values() for d in g} and max(map(len, groups.values())) > 2


def test_numbers_and_schedules_give_way_to_columns_of_their_names(spark):
    from pyspark.sql import functions as F

    names = ["_chunk", "_place", "_n", "_start", "_rank", "_block", "_s", "slot"]
    rows = common.stored(spark.createDataFrame([(i, "ab"[i % 2], *[i] * 8) for i in range(200)], "uid long, source string, " + ", ".join(f"`{x}` int" for x in names)), "clash")
    got = common.ranked(rows, ["source"], F.col("uid") % 3, [F.col("uid")], "rank")
    assert got.columns == [*rows.columns, "rank"] and sorted(r["rank"] for r in got.filter("source = 'a'").collect()) == list(range(100))
    out = pfair.scheduled(rows, "source", "uid", None, 4)
    assert set(names) <= set(out.columns) and out.columns.count("slot") == 1 and sorted(r["_rank"] for r in out.collect()) == list(range(200))


def test_op10_stays_within_a_block(spark, docs, empty):
    weights = {"a": 0.5, "b": 0.3, "c": 0.17, "d": 0.03}
    quota, seen = pfair.quotas(weights, 512), dict.fromkeys(weights, 0)
    for t, s in enumerate(pfair.timetable(quota, 512)):
        seen[s] += 1
        assert all(abs(seen[x] - quota[x] / 512 * (t + 1)) < 1 for x in weights)
    rows = common.stored(spark.createDataFrame([(i, "a" if i % 3 else "b" if i % 2 else None) for i in range(3000)], "uid long, source string"), "rows")
    got = pfair.scheduled(rows, "source", "uid", {"a": 0.2, "b": 0.5, None: 0.3}, 4).toPandas()
    assert sorted(got["uid"]) == list(range(3000)) and got["position"].is_unique
    assert ((got["slot"] >= got["release"]) & (got["slot"] < got["deadline"])).all() and sorted(got["slot"].unique()) == list(range(750))
    out = pfair.mixed(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS) and pfair.mixed(empty).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = kept = common.table(spark, DIR, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        kept, before = common.stored(stage(spark, kept, DIR), name), kept
        assert name == "packing" or kept.columns == docs.columns
        if name == "near_dedup":
            classes = bagminhash.classes(before).filter("kept").select("doc_id")
            assert sorted(kept.select("doc_id").collect()) == sorted(classes.collect())
        if name == "mixing":
            assert kept.exceptAll(before).count() == 0 and kept.count() == before.count()
    assert kept.select("doc_id").distinct().count() == before.count() and corpus_pipeline.run(spark, DIR).count() == kept.count()


def test_pipeline_takes_nulls_repeats_clashing_columns_and_nothing(spark, docs, empty):
    import corpus_pipeline

    left = {"toxicity": len(TEXTS), "near_dedup": 8, "mixing": 8}
    for table, whole in ((docs, True), (empty, False)):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            kept = common.stored(stage(spark, kept, DIR), name)
            if name != "packing":
                assert kept.columns == docs.columns and kept.dtypes == docs.dtypes and kept.count() == (left[name] if whole else 0)
        assert kept.filter("piece = 0").count() == (8 if whole else 0)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 900])
def test_classes_of_words_are_those_of_a_lookup(n):
    from gridframe.llm import pseudo_likelihood as model

    rng = np.random.default_rng(n)
    known = np.unique(np.concatenate([rng.integers(0, 1 << 64, n, dtype=np.uint64), np.array([0, 1, (1 << 64) - 1][: 3 * (n > 4)], np.uint64)]))
    words = np.stack([known, rng.permutation(len(known)).astype(np.uint64)])
    asked = np.concatenate([known, rng.integers(0, 1 << 64, 3000, dtype=np.uint64), np.array([0, 1 << 52, (1 << 64) - 1], np.uint64)])
    code = dict(zip(known.tolist(), words[1].tolist()))
    assert model.classes(asked, words).tolist() == [code.get(h, model.VOCABULARY + h % model.RARE) for h in asked.tolist()]
    assert model.classes(asked[:0], words).tolist() == []


def test_op2_shares_of_a_class_sum_to_one(spark, monkeypatch):
    model = pseudo_likelihood
    monkeypatch.setattr(model, "GROWS", 1200)  # classes grow
    few = [f"w{i}" for i in range(1700)]
    rows = [(i, w) for i, w in enumerate(few)] + [(5000, " ".join(few[:1200])), (5001, "w0 " * 50), (5002, None)]
    table = common.stored(spark.createDataFrame(rows, SCHEMA), "shared")
    every, size = model.vocabulary(table)
    words, of_class, rest, share = model.shared(every, size)
    assert size.sum() == of_class.sum() == 2950 and len(of_class) > model.CLASSES and every.shape[1] == 1700
    code = model.classes(np.array([textkit.word_hashes(w)[0] for w in few]), words)
    own = (code < model.VOCABULARY) | (code >= model.CLASSES)
    of = model.classes(rest, words)
    assert (~own).sum() == len(rest) > 400 and all(np.exp(share[of == c]).sum() == pytest.approx(1) for c in set(of.tolist()))


def test_op10_stays_within_a_block_of_the_weights_on_long_runs(spark, monkeypatch):
    from fractions import Fraction

    weights = {"a": 0.5 + 1e-4, "b": 0.3, "c": 0.2 - 1.3e-4, "d": 3e-5}
    total = sum(map(Fraction, weights.values()))
    blocks = {"a": 20_000, "b": 30_000, "c": 30_000, "d": 30_000}
    seen, first_phase, slots = dict.fromkeys(weights, 0), True, []
    for s, block, target, release, deadline, slot in pfair.placed(blocks, weights):
        slots.append(slot)
        assert block == seen[s] and release <= slot < deadline
        seen[s] += 1
        first_phase = first_phase and target == pytest.approx(weights[s] / float(total), abs=1e-12)
        if first_phase:
            assert abs(seen[s] - Fraction(weights[s]) / total * (slot + 1)) < 1
    assert seen == blocks and slots == list(range(sum(blocks.values())))
    # the same rows come out when the driver holds few blocks and joins them
    rows = common.stored(spark.createDataFrame([(i, "ab"[i % 2] if i % 5 else None) for i in range(900)], "uid long, source string"), "rows")
    want = sorted(map(repr, pfair.scheduled(rows, "source", "uid", None, 4).collect()))
    monkeypatch.setattr(pfair, "HELD", 50)
    monkeypatch.setattr(pfair, "BROADCAST", 0)
    got = pfair.scheduled(rows, "source", "uid", None, 4)
    assert sorted(map(repr, got.collect())) == want and len(want) == 900
    n = {r["source"]: r["target"] for r in got.filter("slot = 0 or slot < 5").collect()}
    root = {"a": 360**0.5, "b": 360**0.5, None: 180**0.5}
    assert all(v == pytest.approx(root[s] / sum(root.values())) for s, v in n.items())


def test_op3_sequences_follow_the_order_of_the_input(spark):
    rnd = random.Random(2)
    rows = [(i, "lorem ipsum dolor " * rnd.choice([3, 20, 47, 90, 130, 333, 700])) for i in rnd.sample(range(10_000), 4000)]
    at = {doc: k for k, (doc, _) in enumerate(rows)}
    table = spark.createDataFrame(rows, SCHEMA).repartition(1).limit(0).unionByName(spark.createDataFrame(rows, SCHEMA))
    for docs in (table, common.stored(table, "lined")):
        got = packing.packed(docs).toPandas()
        got["at"] = got["doc_id"].map(at)
        first = got.groupby("sequence_id")["at"].min().sort_index()
        assert (first.diff().dropna() >= 0).all() and sorted(first.index) == list(range(len(first)))
        spread = got.groupby("sequence_id")["at"].agg(lambda v: v.max() - v.min())
        assert spread.mean() < 0.1 * len(rows)  # a sequence's pieces are near one another


def test_pipeline_packs_in_the_order_of_the_mixture(spark):
    import corpus_pipeline

    docs = common.stored(common.table(spark, DIR, "documents"), "docs")
    keys = common.stored(docs.selectExpr("doc_id", "monotonically_increasing_id() as uid", "cast(source as string) as source"), "keys")
    at = {r["doc_id"]: r["position"] for r in pfair.scheduled(keys, "source", "uid").collect()}
    mixed = common.stored(corpus_pipeline.mix_sources(spark, docs, DIR), "mixed")
    got = corpus_pipeline.pack(spark, mixed, DIR).toPandas()
    first = got.assign(at=got["doc_id"].map(at)).groupby("sequence_id")["at"].min().sort_index()
    assert (first.diff().dropna() >= 0).all() and len(first) > 20


def test_op3_added_tokens_are_those_of_tokenizers():
    from tokenizers import Tokenizer

    encoder, plain = tokens.encoder(tokens.default_path()), Tokenizer.from_file(tokens.default_path())
    assert encoder.ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    for text in ("<|endoftext|>", "x<|endoftext|><|endoftext|>y", "<|endoftext", "a |endoftext|> b"):
        assert encoder.ids(text).tolist() == encoder.exact(text) == plain.encode(text, add_special_tokens=False).ids
